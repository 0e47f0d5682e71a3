"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a segment, a word or a part of a long one, in both directions, gives each position
a distribution over the languages, and a document the mean of the logarithms over all its positions, normalised. It is
trained in numpy by backpropagation through time. As a segment's positions depend on the segment alone, a task runs the
network once per distinct segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outpulse.llm.common import as_bytes

#: Bytes of a segment at most, not counting a blank behind it; longer words are several segments.
SEGMENT = 6
HIDDEN = 12
#: Size of a byte's vector.
EMBEDDED = 8
#: The training sample: so many documents of each language at most, and so many bytes of each.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 3000
#: Segments drawn from the sample for every language at most, so that the time to fit does not depend on the corpus.
SAMPLE_SEGMENTS = 20_000
#: Evidence of a position counts this part, as neighbouring positions are not independent.
TEMPER = 0.2
#: Distinct segments that a task remembers.
REMEMBERED = 200_000

_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


_SEGMENT = re.compile(rb"[^\t-\r ]{1,%d}[\t-\r ]?" % SEGMENT)


def segments_of(text: bytes) -> list[bytes]:
    """The words of a text with the blank behind them, longer ones in parts."""
    return _SEGMENT.findall(text)


def padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments as rows of byte + 1, with 0 behind their end, and their lengths."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    width = int(lengths.max())
    joined = b"".join(s.ljust(width, b"\0") for s in segments)
    codes = np.frombuffer(joined, np.uint8).reshape(len(segments), width).astype(np.int64) + 1
    codes[np.arange(width) >= lengths[:, None]] = 0
    return codes, lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    # Far out, where exp() would overflow, the value no longer changes.
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    # Several times as fast as numpy's own.
    return 2 * _sigmoid(2 * x) - 1


class Network:
    """Weights by name. ``i`` and ``h`` are input and recurrent weights of a direction, for update, reset, candidate."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, embedded: int = EMBEDDED, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden

        def matrix(*shape: int) -> np.ndarray:
            return draw.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.w = {"embed": draw.normal(0, 0.5, (257, embedded)).astype(np.float32), "out": matrix(2 * hidden, len(languages))}
        self.w["bias"] = np.zeros(len(languages), np.float32)
        for side in ("forward", "backward"):
            self.w[f"{side}_i"] = matrix(embedded, 3 * hidden)
            self.w[f"{side}_h"] = matrix(hidden, 3 * hidden)
            self.w[f"{side}_b"] = np.zeros(3 * hidden, np.float32)

    def _run(self, side: str, codes: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states at each position, step by step in the direction of ``side``."""
        k, (rows, width) = self.hidden, codes.shape
        # A byte's share of the gates is looked up.
        table = self.w["embed"] @ self.w[f"{side}_i"] + self.w[f"{side}_b"]
        recurrent = self.w[f"{side}_h"]
        state = np.zeros((rows, k), np.float32)
        states = np.empty((width, rows, k), np.float32)
        for t in range(width) if side == "forward" else range(width - 1, -1, -1):
            given = table[codes[:, t]]
            fed = state @ recurrent
            gates = _sigmoid(given[:, : 2 * k] + fed[:, : 2 * k])
            update, reset = gates[:, :k], gates[:, k:]
            candidate = _tanh(given[:, 2 * k :] + reset * fed[:, 2 * k :])
            after = state + update * (candidate - state)
            # Behind the end of a segment nothing changes.
            after = np.where((codes[:, t] > 0)[:, None], after, state)
            if keep is not None:
                keep.append((t, state, fed, update, reset, candidate))
            states[t] = state = after
        return states

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each language at each position: width x rows x languages."""
        states = np.concatenate([self._run("forward", codes, None), self._run("backward", codes, None)], axis=2)
        scores = states @ self.w["out"] + self.w["bias"]
        scores -= scores.max(axis=2, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=2, keepdims=True))

    def segment_scores(self, segments: list[bytes]) -> np.ndarray:
        """Sums of the log probabilities over the positions of each segment, with the number of positions as last column."""
        result = np.empty((len(segments), len(self.languages) + 1), np.float32)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        for at in range(0, len(order), 1024):
            chosen = order[at : at + 1024]
            codes, lengths = padded([segments[i] for i in chosen])
            inside = (codes > 0).T[:, :, None]
            result[chosen, :-1] = (self.log_probabilities(codes) * inside).sum(axis=0)
            result[chosen, -1] = lengths
        return result

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss per position and its gradients, by backpropagation through time."""
        k, (rows, width) = self.hidden, codes.shape
        kept: dict[str, list] = {"forward": [], "backward": []}
        states = np.concatenate([self._run(side, codes, kept[side]) for side in kept], axis=2)
        scores = states @ self.w["out"] + self.w["bias"]
        scores -= scores.max(axis=2, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=2, keepdims=True)
        inside = (codes > 0).T
        n = inside.sum()
        at_label = p[:, np.arange(rows), labels]
        loss = float(-(np.log(at_label + 1e-9) * inside).sum() / n)
        p[:, np.arange(rows), labels] -= 1
        p *= inside[:, :, None] / n
        grads = {name: np.zeros_like(w) for name, w in self.w.items()}
        flat = states.reshape(-1, 2 * k)
        grads["out"] = flat.T @ p.reshape(-1, p.shape[2])
        grads["bias"] = p.sum(axis=(0, 1))
        into = p @ self.w["out"].T
        for side, part in (("forward", into[:, :, :k]), ("backward", into[:, :, k:])):
            recurrent, table_grad = self.w[f"{side}_h"], np.zeros((257, 3 * k), np.float32)
            carried = np.zeros((rows, k), np.float32)
            for t, state, fed, update, reset, candidate in reversed(kept[side]):
                live = (codes[:, t] > 0)[:, None]
                total = part[t] + carried
                moved = total * live
                d_candidate = moved * update * (1 - candidate**2)
                d_update = moved * (candidate - state) * update * (1 - update)
                d_reset = d_candidate * fed[:, 2 * k :] * reset * (1 - reset)
                d_given = np.concatenate([d_update, d_reset, d_candidate], axis=1)
                d_fed = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
                np.add.at(table_grad, codes[:, t], d_given)
                grads[f"{side}_h"] += state.T @ d_fed
                carried = np.where(live, moved * (1 - update) + d_fed @ recurrent.T, total)
            grads[f"{side}_i"] = self.w["embed"].T @ table_grad
            grads[f"{side}_b"] = table_grad.sum(axis=0)
            grads["embed"] += table_grad @ self.w[f"{side}_i"].T
        return loss, grads


def train(samples: list[tuple[str, bytes]], epochs: int = 3, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """A network fitted to ``(language, text)`` by Adam over segments of similar length."""
    languages = sorted({language for language, _ in samples})
    network = Network(languages, seed=seed)
    if len(languages) < 2:
        return network
    draw = np.random.default_rng(seed)
    by_language = {language: [] for language in languages}
    for language, text in samples:
        by_language[language] += segments_of(text)
    # Every language has the same weight.
    most = min(SAMPLE_SEGMENTS, max(map(len, by_language.values())))
    segments, labels = [], []
    for number, language in enumerate(languages):
        own = by_language[language]
        if own:
            segments += [own[i] for i in draw.integers(0, len(own), most)]
            labels += [number] * most
    labels = np.array(labels)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    first = {name: np.zeros_like(w) for name, w in network.w.items()}
    second = {name: np.zeros_like(w) for name, w in network.w.items()}
    steps, total = 0, epochs * (-(-len(segments) // batch))
    for _ in range(epochs):
        order = np.argsort(lengths + draw.random(len(segments)), kind="stable")
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in draw.permutation(len(groups)):
            codes, _ = padded([segments[i] for i in groups[g]])
            _, grads = network.gradients(codes, labels[groups[g]])
            steps += 1
            scale = rate * (1 - steps / (total + 1))
            for name, grad in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.99 * second[name] + 0.01 * grad**2
                step = first[name] / (1 - 0.9**steps) / (np.sqrt(second[name] / (1 - 0.99**steps)) + 1e-8)
                network.w[name] = (network.w[name] - scale * step).astype(np.float32)
    return network


class Labeller:
    """Predicts documents, remembering the scores of segments."""

    def __init__(self, network: Network):
        self.network, self.numbers, self.scores = network, {}, np.empty((0, len(network.languages) + 1), np.float32)

    def _numbers(self, segments: list[bytes]) -> np.ndarray:
        """Rows of ``scores`` of the segments; the new ones are run first."""
        new = list({s: None for s in segments if s not in self.numbers})
        if new:
            start = len(self.numbers)
            self.numbers.update(zip(new, range(start, start + len(new))))
            self.scores = np.concatenate([self.scores, self.network.segment_scores(new)])
        return np.fromiter(map(self.numbers.__getitem__, segments), np.int64, len(segments))

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and probability; ``und`` and 0 without a letter. Long lists are worked on in parts."""
        labels, scores, at = [], [], 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= 4 << 20):
                size += len(texts[upto])
                upto += 1
            some = self._predict(texts[at:upto])
            labels += some[0]
            scores += some[1]
            at = upto
        return labels, scores

    def _predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if len(self.numbers) > REMEMBERED:
            self.numbers, self.scores = {}, self.scores[:0]
        languages = self.network.languages
        parts = [segments_of(text) for text in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        sums = np.zeros((len(texts), len(languages) + 1))
        if counts.sum() and languages:
            rows = self.scores_of([s for part in parts for s in part])
            filled = np.flatnonzero(counts)
            sums[filled] = np.add.reduceat(rows, (np.cumsum(counts) - counts)[filled], axis=0)
        labels, scores = [], []
        for text, total in zip(texts, sums):
            if not languages or not any(c.isalpha() for c in text.decode("utf-8", "replace")):
                labels.append("und")
                scores.append(0.0)
                continue
            evidence = TEMPER * total[:-1]
            p = np.exp(evidence - evidence.max())
            p /= p.sum()
            labels.append(languages[int(p.argmax())])
            scores.append(float(p.max()))
        return labels, scores

    def scores_of(self, segments: list[bytes]) -> np.ndarray:
        numbers = self._numbers(segments)
        return self.scores[numbers].astype(np.float64)


def sample(docs: DataFrame, usable: Column, per_language: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES) -> list[tuple[str, bytes]]:
    """The training texts: of each language the ``per_language`` documents with the least hash, ``most`` bytes of each.

    Spark keeps that many rows of a language per task before it shuffles them.
    """
    from pyspark.sql import Window

    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.substring(F.col("text").cast("binary"), 1, most).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    chosen = ranked.filter(F.col("n") <= per_language).select("lang", "text").collect()
    return sorted((r.lang, bytes(r.text)) for r in chosen)


def identify(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``docs`` as struct column ``doc`` with ``lang_pred`` and ``score``.

    Any columns and rows; repeated rows are predicted alike. A null text, or one without a letter, is ``und`` with score
    0; so is every text when no language was learned. Texts are read whole. Nothing is shuffled.
    """
    sent, held = docs.sparkSession.sparkContext.broadcast(network), {}

    def predict(texts: pa.Array) -> pa.Array:
        if not held:
            held["labeller"] = Labeller(sent.value)
        labels, scores = held["labeller"].predict(as_bytes(texts))
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], _PREDICTED.names)

    predict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(predict, _PREDICTED).asNondeterministic()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(row, udf(F.col(text).cast("string")).alias("p")).select("doc", "p.*")


def position_labels(network: Network, text: bytes) -> Iterator[tuple[int, str]]:
    """Byte offset and most likely language of every position that is part of a word."""
    for found in _SEGMENT.finditer(text):
        codes, _ = padded([found.group()])
        best = network.log_probabilities(codes)[:, 0].argmax(axis=1)
        for i in range(len(found.group().rstrip())):
            yield found.start() + i, network.languages[int(best[i])]
