"""Toxicity: a learned lexicon, misspellings by Levenshtein automata over its trie, and context windows.

Terms are whole words, far more frequent in documents labelled toxic than in others and in too many of them for chance: of all
words tried, less than ``CHANCE`` is expected to come so far by itself (Chernoff's bound of a word's toxic rows, times the words). One trie
holds them; the Levenshtein automaton runs over it from the root (one edit for terms of 4 and more letters, two from 9 on; a swap of
neighbours is one edit). The product is determinised step by step and its states are kept, so a word costs one table lookup a
letter and most words end in the dead state after a few. Words of the training texts that lie near a term but occur in documents that
are not toxic are known neighbours, and no misspellings. Any other misspelling of a term counts half, and less the more different near
words of the term training met in such documents: times (a + 1/2) / (a + 1/2 + 4 h) of a abusive and h harmless ones.

A family is a beginning that training met with ``ENDINGS`` or more different endings in toxic documents, as surprising by its rows as a
term must be: a stem that is inflected. A beginning of one word alone is none, so ``path`` of ``pathetic`` says nothing of
other words. Other words of a family count by its share of words that only toxic documents have, a half at least; words that clean
documents have do not count.

Each hit has a window of ``WINDOW`` words to each side and a score of being quoted: quotation marks around it inside the
window count one, a word of report its inverse distance, a second-person word less its inverse distance; beyond zero the
hit is a quotation. A logistic regression weighs the plain hits beyond one term and two misspellings (by weight, number, kinds and
density), the terms and misspellings addressed to a second person, and the quoted hits: a term, even with misspellings of others beside it,
that nobody is called, decides nothing. Weights of
plain hits are zero at least and those of quoted hits zero at most, so quoting a term never raises a score above that of the
text without it.

Fitting is spread: labelled rows, ``MAX_TRAINING_ROWS`` at most, are counted and turned into features where they are, and
near copies count once for the lexicon. Only the chosen terms, their near words in these rows and eight numbers a row come to
the driver; ``MAX_TERMS`` bounds the terms, the strongest first, and a model that meets this bound says so in ``left_out``. Defined
results: null text counts as empty, whose score is the regression's at no hits; repeated rows get a row each; without any
labelled row of either class all scores are 0. Labels null in any column are not used, nor are columns other than those named.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeforge.llm.runtime import lean_batches, map_rows, staged

WINDOW = 6
#: Labelled rows that the model is fitted on, at most; which ones is settled by a hash of doc_id.
MAX_TRAINING_ROWS = 20_000
MAX_TERMS = 10_000
KEPT_STATES = 50_000
KEPT_WORDS = 200_000
QUOTES = "\"'“”„«»‹›‘’`"
REPORT = frozenset("said says say saying quote quoted quotes wrote writes called calling calls term word words slur phrase reported reportedly cited citing mentioned dijo dice palabra dit mot sagte wort zitat".split())
#: Second-person words that are no article, pronoun or ending in another of the languages (as du, te, ta, u are).
ADDRESS = frozenset("you your yours you're youre yourself dich dein deine toi vous votre eres usted tus".split())
_word = re.compile(r"[^\W_]+(?:[@$!|*'’][^\W_]+)*")
_opening = re.compile(rf"(?:^|(?<=[\s(\[]))[{QUOTES}](?=\S)")
_closing = re.compile(rf"(?<=\S)[{QUOTES}](?=[\s.,;:!?)\]]|$)")
#: How much more a harmless near word says about a term's other near words than an abusive one.
HARMLESS = 4.0
#: Words that chance alone would bring into the lexicon, at most as expected.
CHANCE = 0.05
#: Different endings that make a beginning of a length in STEMS a family.
ENDINGS, STEMS = 6, (4, 5, 6, 7)
#: Signs that the weights of the features may have (the first feature is the constant).
SIGNS = np.array([0, 1, 1, 1, 1, 1, 1, -1])
#: Which of them counts addressed hits.
ADDRESSED = 4


class FuzzyLexicon:
    """The lexicon's trie times the Levenshtein automaton, determinised as words ask for it.

    A state is a set of (node, letter, edits): letter is "" or, in the middle of a swap, the letter that must follow.
    """

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room: list[int] = [0]  # the most edits of any term below a node
        for term in terms:
            self.term[self._add(term, self.edits(term))] = term
        self._reset()

    def _add(self, letters: str, edits: int) -> int:
        at = 0
        self.room[0] = max(self.room[0], edits)
        for c in letters:
            nxt = self.children[at].get(c)
            if nxt is None:
                nxt = self.children[at][c] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.room.append(0)
            at = nxt
            self.room[at] = max(self.room[at], edits)
        return at

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 4 else 1 if len(term) < 9 else 2

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[dict[tuple[int, str], int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self._state({})  # state 0: dead
        self.start = self._state(self._closed({(0, ""): 0}))

    def _closed(self, nodes: dict[tuple[int, str], int]) -> dict[tuple[int, str], int]:
        """With the nodes reached by leaving out letters of terms."""
        todo = list(nodes.items())
        while todo:
            (node, letter), e = todo.pop()
            if letter:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and e + 1 < nodes.get((child, ""), 99):
                    nodes[child, ""] = e + 1
                    todo.append(((child, ""), e + 1))
        return nodes

    def _state(self, nodes: dict[tuple[int, str], int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            ends = [(e, self.term[n]) for (n, letter), e in nodes.items() if not letter and self.term[n] and e <= self.edits(self.term[n])]
            best = min(ends, default=None)
            self.accepts.append((best[1], best[0]) if best else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[tuple[int, str], int] = {}

        def reach(node: int, letter: str, e: int) -> None:
            if e <= self.room[node] and e < out.get((node, letter), 99):
                out[node, letter] = e

        for (node, letter), e in self.sets[state].items():
            if letter:
                if letter == c:  # the second letter of a swap
                    reach(node, "", e)
                continue
            for own, child in self.children[node].items():
                reach(child, "", e + (own != c))
                if own != c and c in self.children[child]:
                    reach(self.children[child][c], own, e + 1)
            reach(node, "", e + 1)
        self.moves[state][c] = nxt = self._state(self._closed(out))
        return nxt

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or None."""
        state = self.start
        for c in word:
            if not state:
                return None
            nxt = self.moves[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
        found = self.accepts[state]
        if len(self.sets) > KEPT_STATES:
            self._reset()
        return found


@dataclass
class ToxicityModel:
    """Bounded by MAX_TERMS and the training rows, whatever the corpus; ``left_out``: terms beyond MAX_TERMS; ``near``: how much a misspelling of a term counts."""

    terms: dict[str, float] = field(default_factory=dict)
    known: frozenset = frozenset()
    near: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    left_out: int = 0
    families: dict[str, tuple[float, float]] = field(default_factory=dict)
    lexicon: FuzzyLexicon | None = field(default=None, repr=False)
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"lexicon": None, "cache": {}}

    def hit(self, word: str) -> tuple[str, int] | None:
        found = self.cache.get(word, 0)
        if found == 0:
            if self.lexicon is None:
                self.lexicon = FuzzyLexicon(self.terms)
            found = self.lexicon.match(word)
            if not found or found[1]:
                stem = next((word[:k] for k in STEMS if word[:k] in self.families and len(word) > k), None)
                found = None if word in self.known else (stem, 0) if stem else found
            if len(self.cache) < KEPT_WORDS:
                self.cache[word] = found
        return found

    @staticmethod
    def quoted(words: list[str], i: int, left: str, right: str) -> float:
        """The window's score of a quotation of word ``i``; ``left`` and ``right``: the window's text on both sides."""
        score = 0.0
        opened = [m.start() for m in _opening.finditer(left)]
        if opened and not _closing.search(left, opened[-1] + 1) and _closing.search(right):
            score += 1.0
        for j in range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1)):
            if j != i:
                score += ((words[j] in REPORT) - (words[j] in ADDRESS)) / abs(i - j)
        return score

    def hits(self, text: str) -> tuple[int, list[tuple[str, str, int, bool, bool]]]:
        """How many words; (word, term, edits, quoted, addressed) of each hit."""
        text = text.lower()
        words = _word.findall(text)
        hit = self.hit
        if not any(map(hit, set(words))):
            return len(words), []
        spans = [m.span() for m in _word.finditer(text)]
        out = []
        for i, word in enumerate(words):
            found = hit(word)
            if found:
                a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
                # the hit's own letters stand at the border of both sides, so that marks beside it have a neighbour
                left, right = text[max(0, spans[a][0] - 1) : spans[i][0] + 1], text[spans[i][1] - 1 : spans[b - 1][1] + 2]
                out.append((word, *found, self.quoted(words, i, left, right) > 0, not ADDRESS.isdisjoint(words[a:b])))
        return len(words), out

    def features(self, text: str) -> list[float]:
        n, hits = self.hits(text)
        plain = [h for h in hits if not h[3]]
        share = [self.near.get(h[1], 0.5) if h[2] else 1.0 if h[1] in self.terms else self.families[h[1]][1] for h in plain]
        weight = [(self.terms.get(h[1]) or self.families[h[1]][0]) * x for h, x in zip(plain, share)]
        sides = []  # what exact and what misspelt hits say beyond one whole term each
        for misspelt in (False, True):
            some = [(h[1] if h[1] in self.terms else h[0], x) for h, x in zip(plain, share) if bool(h[2]) == misspelt]
            kinds: dict[str, float] = {}
            for kind, x in some:
                kinds[kind] = max(x, kinds.get(kind, 0.0))
            sides.append((max(0.0, sum(x for _, x in some) - 1), max(0.0, sum(kinds.values()) - 1)))
        beyond = sides[0][0] + sides[1][0]
        mean = sum(weight) / max(sum(share), 1e-9)
        return [
            1.0, math.log1p(beyond * mean), math.log1p(sides[0][0]), math.log1p(sides[1][0]), math.log1p(sum(x for h, x in zip(plain, share) if h[4] and h[1] in self.terms)),
            (sides[0][1] + sides[1][1]) / 10, min(1.0, 20 * beyond / (n + 1)), math.log1p(len(hits) - len(plain)),
        ]

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        z = sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression with a ridge, by Newton's method with halved steps where one would go too far."""

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + penalty / 2 * (w**2).sum())

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and cost(w + size * step) > cost(w):
            size /= 2
        w = w + size * step
        if np.abs(step).max() < 1e-8:
            break
    return w


def signed_logistic(x: np.ndarray, y: np.ndarray, signs: np.ndarray = SIGNS) -> np.ndarray:
    """As logistic, without features whose weight would have the wrong sign: the most wrong one goes, until none is."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[used] = logistic(x[:, used], y)
        wrong = np.where(signs * w < 0, np.abs(w), 0.0)
        if not wrong.any():
            return w
        used[int(wrong.argmax())] = False


def weigh(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The regression's weights; that of addressed hits is such, at least, that one term said to a second person has even odds.

    Labels of whole documents say little about single sentences, so this one is a rule and not learned.
    """
    w = signed_logistic(x, y)
    w[ADDRESSED] = max(w[ADDRESSED], -w[0] / math.log(2))
    return tuple(map(float, w))


def text_words(text: str) -> tuple[int, list[str]]:
    """(a hash that near copies share, the different words) of a text."""
    words = _word.findall(text.lower())
    sign = min((zlib.crc32(" ".join(w).encode()) for w in zip(words, words[1:], words[2:], words[3:])), default=zlib.crc32(text.encode()))
    return sign, sorted(set(words))


#: Least count of rows and least log odds of a term.
LEAST_ROWS, LEAST_ODDS = 3, 2.5


def surprise(toxic: int, clean: int, share: float) -> float:
    """The least -ln of the probability that a word of toxic + clean rows is in so many toxic ones, if ``share`` of rows is toxic (Chernoff)."""
    n = toxic + clean
    return toxic * math.log(toxic / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0.0)


def _log_odds(toxic, clean, n: list[int]):
    return math.log((toxic + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))


def _nearness(near: list[tuple[str, str, int]]) -> tuple[frozenset, dict[str, float]]:
    """(known neighbours, how much a misspelling of each term counts) from (word, term, clean rows) of near words."""
    seen = {t: [0, 0] for _, t, _ in near}
    for _, t, clean in near:
        seen[t][clean > 0] += 1
    return frozenset(w for w, _, clean in near if clean), {t: 0.5 * (bad + 0.5) / (bad + 0.5 + HARMLESS * good) for t, (bad, good) in seen.items()}


def chosen_terms(counts: list[tuple[str, int, int]], n: list[int], tried: int) -> tuple[dict[str, float], int]:
    """({term: log odds}, how many MAX_TERMS left out) from (word, toxic rows, clean rows); ``tried``: words of LEAST_ROWS rows or more."""
    least = math.log(max(tried, 1) / CHANCE)
    odds = {w: (_log_odds(t, c, n), t) for w, t, c in counts if t >= LEAST_ROWS and len(w) > 1}
    kept = {w: (o, t) for (w, t0, c) in counts if (w in odds) for o, t in [odds[w]] if o > LEAST_ODDS and surprise(t, c, n[1] / (n[0] + n[1])) > least}
    best = sorted(kept, key=lambda w: (-round(kept[w][0] * math.log(kept[w][1]), 9), w))
    return {w: kept[w][0] for w in best[:MAX_TERMS]}, max(0, len(best) - MAX_TERMS)


def chosen_families(counts: list[tuple[str, int, int, int, int]], n: list[int], tried: int) -> dict[str, tuple[float, float]]:
    """{stem: (log odds, share)} from (stem, toxic rows, clean rows, words of toxic rows only, words of clean rows)."""
    least = math.log(max(tried, 1) / CHANCE)
    found = {}
    for stem, t, c, bad, good in sorted(counts):
        odds = _log_odds(t, c, n) if t >= LEAST_ROWS else 0.0
        share = (bad + 0.5) / (bad + 0.5 + good)
        if bad >= ENDINGS and share >= 0.5 and odds > LEAST_ODDS and surprise(t, c, n[1] / (n[0] + n[1])) > least and not any(stem[:k] in found for k in STEMS):
            found[stem] = odds, share
    return found


def fit(rows: list[tuple[str, int]]) -> ToxicityModel:
    """The model of (text, label) rows, as fit_toxicity makes it of many."""
    chosen: set[int] = set()
    n: list[int] = [0, 0]
    counts: dict[str, list[int]] = {}
    begun: dict[str, list[int]] = {}
    for text, label in rows:
        sign, words = text_words(text)
        if sign not in chosen:
            chosen.add(sign)
            n[label] += 1
            for w in words:
                counts.setdefault(w, [0, 0])[label] += 1
            for stem in {w[:k] for w in words for k in STEMS if len(w) > k}:
                begun.setdefault(stem, [0, 0])[label] += 1
    if not all(n):
        return ToxicityModel()
    terms, left_out = chosen_terms([(w, c[1], c[0]) for w, c in counts.items()], n, sum(sum(c) >= LEAST_ROWS for c in counts.values()))
    endings: dict[str, list[int]] = {}
    for w, c in counts.items():
        for k in STEMS:
            if len(w) > k:
                endings.setdefault(w[:k], [0, 0])[c[0] > 0] += 1
    families = chosen_families([(stem, c[1], c[0], *endings[stem]) for stem, c in begun.items()], n, sum(sum(c) >= LEAST_ROWS for c in begun.values()))
    lexicon = FuzzyLexicon(terms)
    near = [(w, found[0], c[0]) for w, c in counts.items() if (found := lexicon.match(w)) and found[1]]
    known, share = _nearness(near)
    known |= {w for w, c in counts.items() if c[0] and any(w[:k] in families for k in STEMS)}
    model = ToxicityModel(terms, known, share, left_out=left_out, families=families)
    x = np.array([model.features(text) for text, _ in rows])
    model.weights = weigh(x, np.array([label for _, label in rows], dtype=float))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, keep, id_col: str, text_col: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows for whose id column ``keep`` holds.

    The rows are those of least hash of doc_id: their ids (no texts) come to the driver, ``most`` at most. Of rows
    with one doc_id the least text counts, so that a repeated id adds one row, however many it has.
    """
    ids = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    ids = ids.where(keep(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return plain.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep=lambda doc_id: F.lit(True), id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Fitted from at most ``most`` labelled rows; no task holds more than its share of them."""
    spark = docs.sparkSession
    lean_batches(spark)
    rows = staged(training_rows(docs, labels, "toxic", keep, id_col, text_col, most), "toxic-rows")
    kind = "sign bigint, doc_id bigint, label int, words array<string>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_words(x) for x in batch.column(1).to_pylist()]
            signs, words = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), batch.column(0), batch.column(2), pa.array(words, pa.list_(pa.string()))], names=["sign", "doc_id", "label", "words"])

    once = rows.mapInArrow(split, kind).groupBy("sign").agg(F.min_by(F.struct("label", "words"), "doc_id").alias("r"))
    once = staged(once.select("r.label", "r.words"), "toxic-words")
    found = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    n = [found.get(0, 0), found.get(1, 0)]
    if not all(n):
        return ToxicityModel()
    each = once.select("label", F.explode("words").alias("w"))
    words = staged(each.groupBy("w").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")), "toxic-vocabulary")
    tried = words.where(F.col("toxic") + F.col("clean") >= LEAST_ROWS).count()
    # only words that may be chosen come to the driver: in LEAST_ROWS toxic rows at least, and mostly in such
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    able = words.where((F.col("toxic") >= LEAST_ROWS) & (F.length("w") > 1) & (odds > LEAST_ODDS - 1e-6)).orderBy(F.desc("toxic"), "w").limit(4 * MAX_TERMS)
    terms, left_out = chosen_terms([tuple(r) for r in able.select("w", "toxic", "clean").collect()], n, tried)

    def beginnings(w: str):
        return F.explode(F.array_compact(F.array(*(F.when(F.length(w) > k, F.substring(w, 1, k)) for k in STEMS)))).alias("stem")

    begun = once.select("label", F.explode(F.array_distinct(F.flatten(F.transform("words", lambda w: F.array_compact(F.array(*(F.when(F.length(w) > k, F.substring(w, 1, k)) for k in STEMS))))))).alias("stem"))
    begun = staged(begun.groupBy("stem").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")), "toxic-stems")
    ends = words.select("clean", beginnings("w")).groupBy("stem").agg(F.count_if(F.col("clean") == 0).alias("bad"), F.count_if(F.col("clean") > 0).alias("good"))
    able = begun.where((F.col("toxic") >= LEAST_ROWS) & (odds > LEAST_ODDS - 1e-6)).join(ends.where(F.col("bad") >= ENDINGS), "stem").orderBy(F.desc("toxic"), "stem").limit(4 * MAX_TERMS)
    families = chosen_families([tuple(r) for r in able.select("stem", "toxic", "clean", "bad", "good").collect()], n, begun.where(F.col("toxic") + F.col("clean") >= LEAST_ROWS).count())
    harmless = words.where("clean > 0").select("w", beginnings("w")).where(F.col("stem").isin(list(families))).select("w").distinct() if families else words.select("w").limit(0)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(terms)
        for batch in batches:
            hits = [(i, m) for i, w in enumerate(batch.column(0).to_pylist()) if (m := lexicon.match(w)) and m[1]]
            at = pa.array([i for i, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([m[0] for _, m in hits], pa.string()), batch.column(1).take(at)], names=["w", "term", "clean"])

    near = words.select("w", "clean").mapInArrow(match, "w string, term string, clean bigint").collect()  # words near terms in the training rows
    known, share = _nearness(sorted(map(tuple, near)))
    known |= {r["w"] for r in harmless.collect()}  # words of the training rows
    model = ToxicityModel(terms, known, share, left_out=left_out, families=families)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    table = rows.select("doc_id", "text", "label").mapInArrow(measure, "doc_id bigint, label int, x array<double>").toPandas().sort_values("doc_id")
    model.weights = weigh(np.stack(table["x"].to_numpy()), table["label"].to_numpy(dtype=float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row."""
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``limit``."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return batch.filter(pa.array([m.score(x.as_py() or "") < limit for x in batch.column(at)], pa.bool_()))

    return map_rows(docs, clean)
