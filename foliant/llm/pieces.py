"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of pieces. The forward Viterbi scores are exact heuristics
for an A-star search from the lattice's end, which yields the N best
segmentations in order. No piece crosses the beginning of a run of spaces, so
the lattice falls into chunks there. A forward pass that carries the two best
scores gives a chunk's best segmentation and what the second best loses; only
the N - 1 chunks of a text that lose least can differ among its N best, and
these are searched. The N best of a text are the N best sums over its chunks.

Scores are log probabilities. A model of merges has none, only an order of its
pieces, so they are Zipf's for the place in that order; a unigram model's own
scores can be taken instead. A character that the vocabulary lacks is spelled by its byte pieces at the
least score less 10. The ids differ from those of a merge model's own encoder, which merges greedily.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
N_BEST = 4
#: Chunks and their ids that a worker remembers; it forgets them all, between batches, when there are more.
REMEMBERED, REMEMBERED_IDS = 500_000, 4_000_000
PENALTY = 10.0
#: Zipf's law of places: the probability of the piece at place k is in proportion to 1 / (k + ZIPF_SHIFT).
ZIPF_SHIFT = 2.7
ROWS = 128


def zipf_scores(order: list[int]) -> dict[int, float]:
    """Log probabilities of ids from their order, the most frequent first."""
    total = math.log(sum(1 / (k + ZIPF_SHIFT) for k in range(len(order))) or 1.0)
    return {i: -math.log(k + ZIPF_SHIFT) - total for k, i in enumerate(order)}


class _Known(dict):
    """Numbers of chunks; a chunk that has none yet is segmented."""

    def __init__(self, number: Callable[[str], int]) -> None:
        self.number = number

    def __missing__(self, chunk: str) -> int:
        self[chunk] = k = self.number(chunk)
        return k


class Vocabulary:
    """Pieces with their scores, read once on the driver (its size is the model's) and sent to the executors."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int], unknown: int) -> None:
        self.pieces, self.byte_ids, self.unknown = pieces, byte_ids, unknown
        #: Pieces with score and ids; beginnings of pieces that are none themselves with an empty entry.
        self.table: dict[str, tuple] = {p[:k]: () for p in pieces for k in range(1, len(p))} | {p: (s, (i,)) for p, (i, s) in pieces.items()}
        self.root: dict[str, tuple] | None = None  # the trie, which each worker makes for itself
        self.fallback = min((s for _, s in pieces.values()), default=0.0) - PENALTY
        self.text = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.text.setdefault(unknown, b"")
        #: Whether a piece crosses the beginning of a run of spaces, so that a text is one chunk.
        self.whole = any(SPACE in p.lstrip(SPACE) for p in pieces)
        # A chunk also ends between a letter or digit and another character, but for those with which a piece goes across.
        across = {c for p in pieces for a, b in zip(p, p[1:]) if SPACE not in (a, b) and a.isalnum() != b.isalnum() for c in (a, b) if c.isalnum()}
        odd = re.escape("_" + "".join(sorted(across)))
        self.chunk = re.compile(f"{SPACE}*[^\\W{odd}]+|{SPACE}*(?:[^\\w{SPACE}]|[{odd}])+|{SPACE}+")
        self.forget()

    def forget(self) -> None:
        """Of known segmentations of chunks, by number: their ids' place in flat, score, what the second best loses, and whether the ids give the chunk back."""
        self.known = _Known(self.number)
        self.others: dict[str, list[tuple[float, int]]] = {}  # of a chunk's n best, what each loses and its number
        self.flat, self.start, self.score, self.loss, self.exact = array("i"), array("q", [0]), array("d"), array("d"), array("b")

    @classmethod
    def load(cls, model_file: str, scores: str = "zipf") -> Vocabulary:
        """The vocabulary of a model file; scores: 'zipf' from the order of its pieces, 'model' for a unigram model's own."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        pieces, byte_ids = {}, {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = (i, model.get_score(i))
        if scores == "zipf":
            order = sorted((i for i, _ in pieces.values()), key=lambda i: (-model.get_score(i), i))
            own = zipf_scores(order)
            pieces = {p: (i, own[i]) for p, (i, _) in pieces.items()}
        return cls(pieces, byte_ids, model.unk_id())

    def edges(self, chunk: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For each end in the chunk the (start, score, ids) of the pieces that end there, and its best score from the start."""
        n, get = len(chunk), self.table.get
        ends: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        ahead = [0.0] + [float("-inf")] * n
        for i in range(n):  # all pieces that end at i are known by now
            j, here = i + 1, ahead[i]
            found = get(chunk[i])
            if not found:
                self.add_spelled(chunk[i], i, ends, ahead)
            while found is not None:
                if found:
                    score, ids = found
                    ends[j].append((i, score, ids))
                    if here + score > ahead[j]:
                        ahead[j] = here + score
                j += 1
                if j > n:
                    break
                found = get(chunk[i:j])
        return ends, ahead

    def add_spelled(self, c: str, i: int, ends: list, ahead: list[float]) -> None:
        ends[i + 1].append((i, self.fallback, self.spelled(c)))
        ahead[i + 1] = max(ahead[i + 1], ahead[i] + self.fallback)

    def spelled(self, c: str) -> tuple[int, ...]:
        if not self.byte_ids:
            return (self.unknown,)
        return tuple(self.byte_ids.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass"))

    def n_best(self, chunk: str, n: int = N_BEST) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a chunk as (score, ids), best first."""
        ends, ahead = self.edges(chunk)
        out: list[tuple[float, tuple[int, ...]]] = []
        # What is best in all (negative), a number that settles ties, score so far, place, ids after it as nested pairs.
        # Every entry stands for a segmentation of its own with just that score: as many as are still wanted are enough.
        queue = [(-ahead[-1], 0, 0.0, len(chunk), None)]
        pushed = 0
        while queue:
            _, _, score, at, rest = queue.pop(0)
            if at == 0:
                ids: list[int] = []
                while rest:
                    ids += rest[0]
                    rest = rest[1]
                out.append((score, tuple(ids)))
                continue
            room = n - len(out)
            for i, s, own in ends[at]:
                cost = -(score + s + ahead[i])
                if len(queue) < room or cost < queue[-1][0]:
                    pushed += 1
                    insort(queue, (cost, pushed, score + s, i, (own, rest)))
                    del queue[room:]
        return out

    def trie(self) -> dict[str, tuple]:
        """The pieces by characters: of each the score, None where no piece ends, the ids, and what goes on from there."""
        root: dict[str, tuple] = {}
        nodes = {"": (None, (), root)}
        for p in sorted(self.table):  # beginnings come before what goes on from them
            score, ids = self.table[p] or (None, ())
            nodes[p] = nodes[p[:-1]][2][p[-1]] = (score, ids, {})
        return root

    def two_best(self, chunk: str) -> tuple[float, tuple[int, ...], float]:
        """(score, ids, score of the second best) by one forward pass that carries two scores."""
        n, chars = len(chunk), list(chunk)
        if self.root is None:
            self.root = self.trie()
        root, low = self.root.get, float("-inf")
        first, second = [0.0] + [low] * n, [low] * (n + 1)
        starts, parts = [0] * (n + 1), [()] * (n + 1)
        for i, c in enumerate(chars):
            j, best, other = i + 1, first[i], second[i]
            score, ids, further = root(c) or (None, (), None)
            if score is None:
                score, ids = self.fallback, self.spelled(c)
            while True:
                if score is not None:
                    x, old = best + score, first[j]
                    if x > old:
                        y = other + score
                        second[j] = old if old > y else y
                        first[j], starts[j], parts[j] = x, i, ids
                    elif x > second[j]:  # the second way to i is no better than the first
                        second[j] = x
                if not further or j == n:  # no piece goes on so
                    break
                found = further.get(chars[j])
                if found is None:
                    break
                score, ids, further = found
                j += 1
        at, way = n, []
        while at:
            way.append(parts[at])
            at = starts[at]
        return first[n], tuple([i for ids in reversed(way) for i in ids]), second[n]

    def add(self, chunk: str, score: float, ids: tuple[int, ...], loss: float) -> int:
        """The number of a segmentation, which is new."""
        self.flat.extend(ids)
        self.start.append(len(self.flat))
        self.score.append(score)
        self.loss.append(loss)
        self.exact.append(b"".join(map(self.text.__getitem__, ids)) == chunk.encode("utf-8", "surrogatepass"))
        return len(self.score) - 1

    def number(self, chunk: str) -> int:
        """The number of a chunk's best segmentation, which is new."""
        score, ids, second = self.two_best(chunk)
        return self.add(chunk, score, ids, score - second)

    def alternatives(self, chunk: str, n: int) -> list[tuple[float, int]]:
        """What each of the n best segmentations of a chunk loses, and its number, best first."""
        found = self.others.get(chunk)
        if found is None:
            best = self.n_best(chunk, n)
            found = self.others[chunk] = [(best[0][0] - s, self.add(chunk, s, ids, math.inf)) for s, ids in best]
        return found

    def ways(self, text: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a text, best first: the score, and the numbers of the chunks' segmentations."""
        if not text:
            return []
        normal = SPACE + text.replace(" ", SPACE)
        chunks = [normal] if self.whole else self.chunk.findall(normal)
        own = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        best = float(np.frombuffer(self.score)[own].sum())
        loss = np.frombuffer(self.loss)[own]
        # Only the n - 1 chunks whose second best costs least can differ among the n best.
        few = np.argpartition(loss, n - 2)[: n - 1] if 1 < n <= len(loss) else np.arange(len(loss) if n > 1 else 0)
        few = few[np.isfinite(loss[few])]
        #: What a segmentation loses, and the (chunk, number) in which it differs from the best.
        found: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for k in few[np.argsort(loss[few], kind="stable")].tolist():
            more = [(a + x, (*way, (k, m)) if j else way) for a, way in found for j, (x, m) in enumerate(self.alternatives(chunks[k], n))]
            found = heapq.nsmallest(n, more, key=lambda w: w[0])
        for k in few.tolist():  # of equal ones the search's first counts
            own[k] = self.alternatives(chunks[k], n)[0][1]
        out = []
        for lost, way in found:
            numbers = own.copy() if way else own
            for k, m in way:
                numbers[k] = m
            out.append((best - lost, numbers))
        return out

    def ids_of(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segmentations given by numbers, one after the other, and their n + 1 starts."""
        flat, start = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32), np.frombuffer(self.start, np.int64)
        every = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        n = start[every + 1] - start[every]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(start[every] - ends[:-1], n) + np.arange(ends[-1])
        sizes = np.cumsum([0, *map(len, numbers)])
        return flat[at], ends[sizes]

    def gives_back(self, numbers: np.ndarray) -> bool:
        """Whether the ids of segmentations decode to their chunks. (Views of the arrays must not outlive a call: they keep them from growing.)"""
        return bool(np.frombuffer(self.exact, np.int8)[numbers].all())

    def encode(self, text: str, n: int = N_BEST) -> tuple[list[int], list[float]]:
        """The ids of the best segmentation of a text and the scores of the n best, best first."""
        best = self.encode_n_best(text, n)
        return (best[0][1] if best else []), [score for score, _ in best]

    def encode_n_best(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text as (score, ids), best first."""
        found = self.ways(text, n)
        ids, starts = self.ids_of([w for _, w in found])
        return [(score, ids[a:b].tolist()) for (score, _), a, b in zip(found, starts[:-1], starts[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, spaces restored, the leading one dropped."""
        text = b"".join([self.text.get(i, b"") for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _encode(vocabulary: Vocabulary, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            if len(vocabulary.known) > REMEMBERED or len(vocabulary.flat) > REMEMBERED_IDS:
                vocabulary.forget()
            found = [vocabulary.ways(text or "", n) for text in batch.column("text").to_pylist()]
            counts = [len(x) for x in found]
            ends = np.cumsum([0, *counts]).astype(np.int32)
            ids, starts = vocabulary.ids_of([w for x in found for _, w in x])
            every = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            first = np.where(np.diff(ends) > 0, ends[:-1], -1)
            best = every.take(pa.array(first, mask=first < 0)).fill_null(pa.scalar([], pa.list_(pa.int32()))) if len(every) else pa.array([[]] * batch.num_rows, pa.list_(pa.int32()))
            exact = [vocabulary.gives_back(x[0][1]) if x else True for x in found]
            scores = pa.ListArray.from_arrays(pa.array(ends), pa.array([s for x in found for s, _ in x], pa.float64()))
            sizes = pa.array(np.where(first >= 0, np.diff(starts)[first] if len(every) else 0, 0).astype(np.int64))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], sizes, best, scores, pa.array(exact), pa.ListArray.from_arrays(pa.array(ends), every)], [*keep, "n_pieces", "ids", "scores", "exact", "n_best"]
            )


def encode(docs: DataFrame, model_file: str, keys: list[str], text: str = "text", n: int = N_BEST, scores: str = "zipf") -> DataFrame:
    """The columns keys of each row with ids, n_pieces, exact, and the n best segmentations: scores and n_best (their ids; the first are ids).

    exact: whether the ids decode to the text (U+2581 reads as a space). A null
    or empty text has no pieces and no scores. Very long texts are encoded
    whole, chunk by chunk. Of equal segmentations the one that the search finds
    first comes first. Repeated rows are encoded each; columns other than keys
    go, whatever their names; an empty table gives an empty one.
    """
    vocabulary = Vocabulary.load(model_file, scores)
    rows = docs.select(*keys, F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lambda it: _encode(shared.value, n, it), f"{schema}, n_pieces long, ids array<int>, scores array<double>, exact boolean, n_best array<array<int>>")


def decode(encoded: DataFrame, model_file: str, keys: list[str], ids: str = "ids") -> DataFrame:
    """The columns keys of each row with the text of its ids; null ids give an empty text, unknown ids nothing; an empty table gives an empty one."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    rows = encoded.select(*keys, F.col(ids).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_ids")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "_ids"]
            out = [shared.value.decode(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.string())], [*keep, "text"])

    return rows.mapInArrow(texts, f"{schema}, text string")
