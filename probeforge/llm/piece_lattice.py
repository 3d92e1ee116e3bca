"""SentencePiece encoding and decoding by N-best search over the piece lattice.

Texts are escaped as the model file asks (a space before the text, every space a ``▁``). Nodes of the lattice
lie between code points, edges are the model's pieces with their scores; a code point without a piece of its own
is an edge of its byte pieces at a score below all pieces. A forward Viterbi pass gives each node the best score from
the start, the exact heuristic of the backward A* search, which therefore pops complete segmentations best first. Of
equally promising paths the newest goes on first, and a node is expanded at most N times (an N best path never needs
more), so the search ends after N pops a node at most, however many paths tie.

Where no piece holds two code points side by side, no edge crosses between them: the lattice falls apart there, and is
searched unit by unit, equal units once (a bounded memo of a worker; results do not depend on it). The A* search gives
each unit its two best segmentations, hence the gap between them. Only the N - 1 units of least gap can
differ from their best in the text's N best, so the search goes on to N in these, and the N least sums of their losses
give the text's N best, exactly.

The file ``piece_bpe_32k.model`` is a BPE model: its scores are ranks of merges, and the SentencePiece library encodes with
it by merging, not by the best sum of scores. Ids therefore differ from the library's ``encode`` by design of the
method (more pieces here); decoding reads the ids of either. Null text counts as empty and has no pieces; repeated rows get
a row each; other columns are not read. Whole texts are encoded, a text at a time.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_BEST = 4
#: Words and units that a worker's memo holds, those it met first; results do not depend on it.
KEPT_WORDS = 1_200_000
KEPT_UNITS = 600_000
LONG = 64
SPACE = "▁"
SCHEMA = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, score double, n_best int, last_score double, best_scores array<double>, best_pieces array<bigint>, best_crc32 array<bigint>, round_trip boolean"
IDS_SCHEMA = "doc_id bigint, n_best array<struct<score: double, ids: array<int>>>"

Found = tuple[float, tuple[int, ...]]
#: Score, ids and the gap to the next best.
Best = tuple[float, tuple[int, ...], float]


class PieceLattice:
    """Vocabulary and search of one model file."""

    def __init__(self, path: str | None = None):
        import ahocorasick
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        #: Texts of ids; bytes from 0x80 on stand as surrogates until all of a text is joined, control pieces have none.
        self.text_of = [""] * n
        for i in plain:
            self.text_of[i] = model.id_to_piece(i)
        for b, i in self.bytes.items():
            self.text_of[i] = chr(b if b < 0x80 else 0xDC00 + b)
        self.scores = {p: x for p, (_, x) in self.pieces.items()}
        #: Finds all pieces in a text in one pass.
        self.finder = ahocorasick.Automaton()
        for p, x in self.scores.items():
            self.finder.add_word(p, (len(p), x))
        self.finder.make_automaton()
        self.single = {p for p in self.pieces if len(p) == 1}
        self.missing = min(x for x in self.scores.values() if x > -1e8) - 10.0
        #: Two code points side by side in some piece; between all others the lattice is cut.
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.by_words = not any(x[0] != SPACE and x[1] == SPACE for x in self.joined)
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.units: dict[str, Best] = {}
        self.more: dict[tuple[str, int], list[Found]] = {}
        self.long: dict[tuple[str, int], list[Found]] = {}  # of the text at hand
        self.words: dict[str, int] = {}
        self.passing: list[str] = []  # words of the text at hand that the memo does not keep
        self.word_score, self.word_gap = np.zeros(1024), np.zeros(1024)
        self.word_first, self.word_size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(8192, np.int32), 0

    def escape(self, text: str) -> str:
        return (SPACE + text.replace(" ", SPACE)) if text else ""

    def ids(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece)
        return (found[0],) if found else tuple(self.bytes[b] for b in piece.encode())

    def search(self, text: str, n: int) -> list[Found]:
        """The n best (score, ids) of an escaped text or unit, best first: A* from the end with Viterbi scores as what is to come."""
        size = len(text)
        if size == 1:
            return [(self.scores.get(text, self.missing), self.ids(text))]
        edges: list = self.finder.iter(text)
        if not self.single.issuperset(text):
            found = list(edges)
            found += [(i, (1, self.missing)) for i, c in enumerate(text) if c not in self.single]
            edges = sorted(found)
        # into a node: (less the best score up to it over the edge, start, score of the edge)
        best = [0.0]
        into: list[list[tuple[float, int, float]]] = [[]]
        node = -1
        for last, (length, score) in edges:
            start = last - length + 1
            if last != node:
                node = last
                here: list[tuple[float, int, float]] = []
                into.append(here)
                best.append(best[start] + score)
            over = best[start] + score
            if over > best[-1]:
                best[-1] = over
            here.append((-over, start, score))
        push, pop = heapq.heappush, heapq.heappop
        agenda: list[tuple[float, int, int, float, tuple | None]] = [(-best[size], 0, size, 0.0, None)]
        pops = [0] * (size + 1)
        count, ids_of = 0, self.ids
        found = []
        while agenda:
            _, _, node, done, path = pop(agenda)
            if not node:
                ids: list[int] = []
                at = 0
                while path:
                    end, path = path
                    ids += ids_of(text[at:end])
                    at = end
                found.append((done, tuple(ids)))
                if len(found) == n:
                    break
                continue
            here = into[node]
            if not pops[node]:
                here.sort()
            elif pops[node] == n:
                continue
            pops[node] += 1
            path = (node, path)
            for over, start, score in here[:n]:  # an N best path takes one of the N best edges of each of its nodes
                count -= 1
                push(agenda, (over - done, count, start, done + score, path))
        return found

    def cut(self, word: str) -> list[str]:
        """The units of an escaped word."""
        joined = self.joined
        ends = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
        if not ends:
            return [word]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)])]

    def unit(self, unit: str) -> Best:
        found = self.units.get(unit)
        if found is None:
            some = self.unit_best(unit, 2) if len(unit) >= LONG else self.search(unit, 2)
            found = (*some[0], some[0][0] - some[1][0] if len(some) > 1 else math.inf)
            if len(unit) < LONG and len(self.units) < KEPT_UNITS:
                self.units[unit] = found
        return found

    def unit_best(self, unit: str, n: int) -> list[Found]:
        """The unit's n best; its best is the same for every n."""
        kept = self.more if len(unit) < LONG and len(self.more) < KEPT_UNITS // 8 else self.long
        found = kept.get((unit, n))
        if found is None:
            found = self.search(unit, n)
            if n > 2:
                first = self.unit(unit)[:2]
                found = [first, *(x for x in found if x[1] != first[1])][:n]
            kept[unit, n] = found
        return found

    def merged(self, parts: Sequence[tuple[float, object]], n: int, more) -> list[tuple[float, dict]]:
        """The n best of parts one after another, as (loss, {part: what it has instead of its best}); parts: (gap, key) of each, more(key): its n best."""
        least = heapq.nsmallest(n - 1, ((gap, i) for i, (gap, _) in enumerate(parts) if gap < math.inf))
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for _, i in sorted(least, key=lambda g: g[1]):
            some = more(parts[i][1])
            sums = heapq.nsmallest(n, ((loss + some[0][0] - score, chosen + (((i, ids),) if k else ())) for loss, chosen in sums for k, (score, ids) in enumerate(some)), key=lambda x: x[0])
        return [(loss, dict(chosen)) for loss, chosen in sums]

    def word_best(self, key: str, n: int) -> list[Found]:
        """The n best of the word ``▁`` + key."""
        units = self.cut(SPACE + key)
        if len(units) == 1:
            return self.unit_best(units[0], n)
        own = list(map(self.unit, units))
        total = math.fsum(x[0] for x in own)
        found = self.merged([(x[2], u) for x, u in zip(own, units)], n, lambda u: self.unit_best(u, n))
        return [(total - loss, tuple(itertools.chain.from_iterable(chosen.get(i, x[1]) for i, x in enumerate(own)))) for loss, chosen in found]

    def _learn(self, key: str) -> int:
        """The number of a new word, whose best segmentation and gap are kept."""
        score, ids, gap = 0.0, [], math.inf
        for unit in self.cut(SPACE + key):
            more, some, next_ = self.unit(unit)
            score += more
            ids += some
            if next_ < gap:
                gap = next_
        at, end = len(self.words), self.used + len(ids)
        if at == len(self.word_score):
            for name in ("word_score", "word_gap", "word_first", "word_size"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : end] = ids
        self.word_score[at], self.word_gap[at] = score, gap
        self.word_first[at], self.word_size[at] = self.used, len(ids)
        self.used = end
        self.words[key] = at
        if len(key) >= LONG or at >= KEPT_WORDS or self.passing:
            self.passing.append(key)
        return at

    def keys(self, text: str) -> list[str]:
        """The words of a text, each without the ``▁`` before it."""
        if not text:
            return []
        if not self.by_words:
            return [text.replace(" ", SPACE)]
        words = text.split(" ")
        return [w[1:] for w in self.word.findall(SPACE + text.replace(" ", SPACE))] if "" in words else words

    def n_best(self, text: str, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a text, best first."""
        if self.passing:
            self.used = int(self.word_first[self.words[self.passing[0]]])
            for key in self.passing:
                del self.words[key]
            self.passing.clear()
        self.long.clear()
        keys = self.keys(text)
        numbers = list(map(self.words.get, keys))
        if None in numbers:
            words, learn = self.words, self._learn
            for i in [i for i, x in enumerate(numbers) if x is None]:
                key = keys[i]
                numbers[i] = words[key] if key in words else learn(key)
        at = np.array(numbers, np.int64)
        size = self.word_size[at]
        ends = np.cumsum(size)
        first = self.flat[np.repeat(self.word_first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        score, gaps = float(self.word_score[at].sum()), self.word_gap[at]
        if n == 1 or not len(at):
            return [(score, first)][:n]
        few = np.argsort(gaps, kind="stable")[: n - 1] if len(at) < 64 else np.flatnonzero(gaps <= np.partition(gaps, n - 2)[n - 2])
        few = np.sort(few[np.argsort(gaps[few], kind="stable")[: n - 1]])
        out = []
        for loss, chosen in self.merged([(gaps[i], keys[i]) for i in few], n, lambda k: self.word_best(k, n)):
            ids, parts, done = first, [], 0
            for j in sorted(chosen):
                i = few[j]
                parts += [first[done : ends[i] - size[i]], np.array(chosen[j], np.int32)]
                done = ends[i]
            if parts:
                ids = np.concatenate([*parts, first[done:]])
            out.append((score - loss, ids))
        return out

    def encode(self, text: str) -> list[int]:
        """The best segmentation's ids."""
        return self.n_best(text, 1)[0][1].tolist()

    def encodings(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best (score, ids)."""
        return [(score, ids.tolist()) for score, ids in self.n_best(text, n)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the leading space that escaping adds is taken off."""
        text = "".join(map(self.text_of.__getitem__, ids))
        try:
            text.encode()
        except UnicodeEncodeError:  # bytes of code points without a piece
            text = text.encode(errors="surrogateescape").decode(errors="replace")
        text = text.replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


_lattice: list[PieceLattice] = []


def lattice() -> PieceLattice:
    """One for each Python worker."""
    if not _lattice:
        _lattice.append(PieceLattice())
    return _lattice[0]


def _plain(docs: DataFrame, id_col: str, col: str, kind: str, name: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{col}`").cast(kind).alias(name))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """IDS_SCHEMA for each row: the n best segmentations, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = lattice()
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [[{"score": s, "ids": ids} for s, ids in search.n_best(x.as_py() or "", n)] for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "n_best"])

    return _plain(docs, id_col, text_col, "string", "text").mapInArrow(run, IDS_SCHEMA)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's array of ids (null: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = lattice()
        for batch in batches:
            texts = [None if x is None else search.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _plain(encoded, id_col, ids_col, "array<int>", "ids").mapInArrow(run, "doc_id bigint, text string")


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """SCHEMA for each row: of each of the n best segmentations the score, the number of pieces and the ids' CRC-32 (little-endian
    unsigned 32-bit), the best's in columns of their own; whether decoding the best gives the text again (``▁`` read as a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = lattice()
        gc.disable()  # the memo holds no cycles, but very many tuples to look through
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                found = search.n_best(text, n)
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found]
                scores, sizes = [s for s, _ in found], [len(ids) for _, ids in found]
                rows.append((sizes[0], crcs[0], scores[0], len(found), scores[-1], scores, sizes, crcs, search.decode(found[0][1].tolist()) == text.replace(SPACE, " ")))
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return _plain(docs, id_col, text_col, "string", "text").mapInArrow(run, SCHEMA)
