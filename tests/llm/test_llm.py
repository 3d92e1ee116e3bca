"""Corpus operators against brute force, exact round trips or held-out accuracy, and their defined edge cases."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from probeforge.llm import html_wrapper, line_dedup, lm_score, neighbours, packing, piece_lattice, quality_fm, quality_rules, simhash, textio, toxicity
from probeforge.llm.queries import queries, remainder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in texts], KIND)


EDGE = [(1, None), (2, ""), (3, "   \n\n"), (4, "word " * 30000), (4, "word " * 30000), (None, "no id here"), (6, "x" * 5000), (7, "Ünï cödé 😀 text\x85")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r["doc_id"]: r["text"] for r in corpus.collect()}


# 1


def brute_lines(docs, least=30):
    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return a == b
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]

    lines = [(d, n, " ".join(WORD.findall(line))) for d, t in sorted(docs) for n, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for d, n, line in lines:
        first.setdefault(line, (d, n))
    by = defaultdict(list)
    for line in (x for x in first if len(x) >= least):
        for key in {line[:10], line[-10:]}:
            by[key].append(line)
    best = dict(first)
    for group in by.values():
        for a, b in itertools.combinations(group, 2):
            if near(a, b):
                best[a], best[b] = min(best[a], first[b]), min(best[b], first[a])
    gone = defaultdict(list)
    for d, n, line in lines:
        if (d, n) > best[line]:
            gone[d].append(n)
    return gone


def test_line_dedup(spark, texts):
    rng = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog while nobody is looking at it at all, " * 3
    extra = []
    for i in range(60):
        at = rng.randrange(len(base))
        extra.append((10_000 + i, rng.choice([base[:at] + base[at + 1 :], base[:at] + "z" + base[at:], base[:at] + "q" + base[at + 1 :], base]) + "\nshort\n\n"))
    docs = list(texts.items()) + extra
    got = {r["doc_id"]: (r["removed_lines"], r["text"], r["n_lines"]) for r in line_dedup.line_dedup(documents(spark, docs)).collect()}
    want = brute_lines(docs)
    for d, t in docs:
        lines = t.split("\n")
        assert got[d] == (want[d], "\n".join(x for n, x in enumerate(lines) if n not in set(want[d])), len(lines)), d


def test_line_dedup_edges(spark):
    out = line_dedup.line_dedup(documents(spark, EDGE).withColumn("key", F.lit(1)).withColumn("line", F.lit("clash")).withColumn("a.b", F.lit(1))).collect()
    assert len(out) == len(EDGE) and {r["line"] for r in out} == {"clash"}
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(EDGE) and all(not r["removed_lines"] for r in out)
    assert line_dedup.line_dedup(documents(spark, EDGE).limit(0)).count() == 0


def test_line_dedup_joins_agree(spark, texts, monkeypatch):
    """Equal lines of any length go; broadcast and shuffle joins give the same rows."""
    docs = documents(spark, [*texts.items(), (9001, "All rights reserved.\nx\ny "), (9002, "All \t rights reserved.\n\n y\nz"), (9003, "All rights reservd.")])
    a = sorted(map(str, line_dedup.line_dedup(docs).collect()))
    rows = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert rows[9002]["text"] == "\nz" and rows[9002]["removed_lines"] == [0, 2] and rows[9003]["removed_lines"] == []
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(str, line_dedup.line_dedup(docs).collect())) == a


# 2


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(fps, bits=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= bits:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def test_simhash(spark, texts):
    docs = list(texts.items()) + [(10_000 + i, t) for i, t in enumerate([None, "", "one", "a b", *list(texts.values())[:5]])]
    got = simhash.simhash_components(documents(spark, docs)).withColumn("hex", simhash.hex_fingerprint()).collect()
    fps = {d: brute_fingerprint(t) for d, t in docs}
    roots = closed(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    assert {(r["doc_id"], r["hex"], r["component_id"]) for r in got} == {(d, f"{f:016x}", least[roots[f]]) for d, f in fps.items()}
    assert simhash.simhash_components(documents(spark, EDGE)).count() == len(EDGE)
    assert simhash.simhash_components(documents(spark, EDGE).limit(0)).count() == 0


def test_long_lists_and_chains(spark, monkeypatch):
    rng = random.Random(2)
    seed = rng.getrandbits(64)
    fps = {seed}
    for _ in range(400):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.choice((1, 2, 3))):
            x ^= 1 << b
        fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    want = closed({f for f in fps})
    for most in (64, 4):
        monkeypatch.setattr(simhash, "LONG_LIST", most)
        found = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.fingerprint_links(df)).collect()}
        groups = defaultdict(set)
        for f in fps:
            groups[found.get(f, f)].add(f)
        expect = defaultdict(set)
        for f, r in want.items():
            expect[r].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


# 3


def test_lm_scores(spark, corpus, texts):
    train = remainder(F.col("doc_id"), 5) != 1
    a = {r["doc_id"]: r for r in lm_score.lm_scores(corpus, train).collect()}
    b = {r["doc_id"]: r for r in lm_score.lm_scores(corpus, train, max_bytes=0).collect()}
    tokens = {d: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None] for d, t in texts.items()}
    uni, bi, ctx = Counter(), Counter(), Counter()
    for d, t in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            uni.update(t)
            bi.update(zip(["<s>", *t], t))
            ctx.update(["<s>", *t[:-1]])
    q = {}
    for k, c in bi.items():
        if c >= 2:
            lv = math.floor(math.log(c / 2) / math.log(1.25) + 1e-9)
            q[k] = math.ceil(2 * 1.25**lv - 1e-9)
    s, kinds = Counter(), Counter()
    for (u, _), c in q.items():
        s[u] += c
        kinds[u] += 1
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    for d, t in tokens.items():
        base = sum(math.log10(p1(w)) for w in t)
        score = sum(math.log10((q.get((u, w), 0) + (ctx[u] - s[u] + kinds[u] + 1) * p1(w)) / (ctx[u] + kinds[u] + 1)) for u, w in zip(["<s>", *t], t))
        assert (a[d]["n_tokens"], a[d]["n_known"], a[d]["train_tokens"]) == (len(t), sum(uni[w] > 0 for w in t), n)
        assert abs(a[d]["base_score"] - base) < 1e-6 and abs(b[d]["base_score"] - base) < 1e-6
        assert abs(a[d]["score"] - b[d]["score"]) < 1e-9 * max(1, abs(score)) and a[d]["score"] > score - 1e-6  # false positives only raise a score
    held = [d for d in tokens if zlib.crc32(str(d).encode()) % 5 == 1]
    assert sum(a[d]["score"] for d in held) > sum(a[d]["base_score"] for d in held)
    for most in (lm_score.MAX_BYTES, 0):
        edge = [sorted(map(str, lm_score.lm_scores(documents(spark, EDGE).withColumn("h", F.lit(1)).withColumn("a.b", F.lit(1)), train, max_bytes=most).collect())) for train in (F.lit(True), F.lit(False))]
        assert [len(x) for x in edge] == [len(EDGE)] * 2
    assert lm_score.lm_scores(documents(spark, EDGE).limit(0), F.lit(True)).count() == 0


def test_count_filter(spark):
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(3))
    inside, outside = h[::2], h[1::2]
    assert [r[0] for r in spark.createDataFrame([(int(x),) for x in h[:500].view(np.int64)], "h long").select(F.pmod(F.hash("h"), F.lit(7))).collect()] == lm_score.shard_of(h[:500], 7).tolist()
    rank = 1 + rng.geometric(0.5, len(inside)) % 9
    own = lm_score.shard_of(inside, 5)
    counts = lm_score.CountFilter({k: lm_score.CountFilter.shard(inside[own == k], rank[own == k]) for k in range(5)}, 5)
    assert (counts.ranks(inside) >= rank).all() and (counts.ranks(inside) > rank).mean() < 0.03 and (counts.ranks(outside) > 0).mean() < 0.03
    for least in (1, 2, 3):
        c = np.arange(least, 5000)
        q = lm_score.level(c, least)
        assert set(q) <= set(lm_score.steps(least)) and (lm_score.level_count(q, least) <= c).all()
        assert (lm_score._quantised(np.searchsorted(lm_score.steps(least), q) + 1, least) == lm_score.level_count(q, least)).all()


def test_lm_scores_every_bigram(spark):
    """The registered query scores with bigrams that occur once as well."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {d: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None] for d, t in texts.items()}
    train = [t for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t))
    q = {k: math.ceil(1.25 ** math.floor(math.log(c) / math.log(1.25) + 1e-9) - 1e-9) for k, c in bi.items()}
    ctx, s, kinds = Counter(), Counter(), Counter()
    for (u, _), c in bi.items():
        ctx[u] += c
    for (u, _), c in q.items():
        s[u], kinds[u] = s[u] + c, kinds[u] + 1
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    got = {r["doc_id"]: r["score"] for r in queries()["op3_lm_scoring"](spark, SF).collect()}
    whole = 0.0
    for d, t in tokens.items():
        want = sum(math.log10((q.get((u, w), 0) + (ctx[u] - s[u] + kinds[u] + 1) * p1(w)) / (ctx[u] + kinds[u] + 1)) for u, w in zip(["<s>", *t], t))
        assert got[d] > want - 1e-6, d  # false positives of the filter only raise a score
        whole += want
    assert sum(got.values()) - whole < 0.01 * abs(whole)


def test_hashed_words():
    col = textio.binary_column(pa.array(["A b\tc", None, "", " a  B ", "é 日本 A"]))
    row, h = textio.hashed_words(col.slice(0, 5))
    assert row.tolist() == [0, 0, 0, 3, 3, 4, 4, 4] and h[0] == h[3] == h[7] and h[1] == h[4] and len(set(h.tolist())) == 5


# 4 and 10


@pytest.mark.parametrize("name", ["op4_quality_classifier", "op10_toxicity"])
def test_held_out_accuracy(spark, name):
    sf = "/root/testdata/sf0.1"
    label = "quality" if name.startswith("op4") else "toxic"
    out = queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] > 0.97 and 0 <= r["lo"] <= r["hi"] <= 1


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, EDGE)
    assert {r["score"] for r in quality_fm.score_quality(docs, quality_fm.fit_quality(docs, labels)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()} == {0.0}


def test_levenshtein_lexicon():
    """The automaton against the distance of all pairs; a swap of neighbours is one edit, and any letter may be wrong."""

    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    terms = {t: 1.0 for t in ("moron", "idiot", "disgusting", "scum", "pathetic", "ass", "worthless")}
    lexicon = toxicity.FuzzyLexicon(terms)
    rng = random.Random(1)
    words = {"".join(rng.choice("moronidtscugp") for _ in range(rng.randint(1, 9))) for _ in range(3000)}
    for t in terms:
        for i in range(len(t)):
            words |= {t[:i] + t[i + 1 :], t[:i] + "x" + t[i:], t[:i] + "x" + t[i + 1 :], t[:i] + "xy" + t[i:], t[:i] + t[i + 1 : i + 2] + t[i] + t[i + 2 :]}
    assert {"odiot", "diot", "xidiot", "idoit", "isgusting", "scvm"} - {w for w in words | {"odiot", "scvm"} if lexicon.match(w)} == set()
    for w in words - {""}:
        near = {t: distance(w, t) for t in terms if distance(w, t) <= lexicon.edits(t)}
        found = lexicon.match(w)
        assert (found is not None) == bool(near), w
        assert not near or (near[found[0]], found[1]) == (min(near.values()),) * 2, w
    # a beginning counts only if training met it as a family, and not in words that clean texts have
    family = toxicity.ToxicityModel({"stupid": 1.0}, frozenset({"stupor"}), families={"stup": (2.0, 0.8)})
    assert [family.hit(w) for w in ("stupid", "stupidly", "stup", "stupor", "xstupor", "stpuid")] == [("stupid", 0), ("stup", 0), None, None, None, ("stupid", 1)]


def toxic_rows():
    """Documents of two and more terms, some misspelt, and clean ones; one beginning has many endings, ``path`` of pathetic has one."""
    rng, calm = random.Random(3), "the river runs past a quiet town where people walk and trade every morning".split()
    mixed = lambda *some: " ".join(rng.sample([*some, *rng.sample(calm, 8)], 8 + len(some)))
    bad = ["idiot", "moron", "pathetic", "trash"]
    rows = [(mixed(*rng.sample(bad, 2), str(i)), 1) for i in range(60)] + [(mixed(*("quel" + rng.choice(("a", "ou", "tion", "ment", "is", "ez", "ant", "e")) for _ in range(3)), str(i)), 1) for i in range(60)]
    return rows + [(mixed(str(i)), 0) for i in range(300)]


def test_terms_are_whole_words():
    m = toxicity.fit(toxic_rows())
    assert set(m.families) == {"quel"} and "path" not in m.terms and not m.left_out
    for plain in ("the pathology of a path", "a trashy idiom", "moronic pathways", "the town's trash", "clowns and trash cans"):
        assert m.score(plain) < 0.3, plain
    assert m.score("a quelique quelor town and quelux") > 0.3 > m.score("a quel town")
    # misspelling decides: without its edits the text has no hit; so does quoting
    assert m.score("you idiott and morron, so pathetik") > 0.5 > 0.3 > m.score("you idioms and moors, so poetic")
    assert m.score("he wrote 'idiot' and called it 'trash'") < 0.3 < m.score("idiot and trash")
    assert m.score("you are an idiot") >= 0.5 - 1e-9


@pytest.mark.parametrize("share", [0.05, 0.2])
def test_chance_brings_no_terms(share):
    """Random labels on rare words: next to none is surprising enough."""
    rng = random.Random(8)
    rows = [(" ".join(f"w{int(rng.paretovariate(0.6)) % 20000}" for _ in range(40)), int(rng.random() < share)) for _ in range(1500)]
    assert len(toxicity.fit(rows).terms) <= 1


def test_quotation_and_misspelling():
    rows = [(f"you are such an idiot and moron {i} go away", 1) for i in range(60)] + [(f"the weather is fine today {i} and mild", 0) for i in range(200)] + [(f'he said the word "idiot" was used {i} there', 0) for i in range(60)]
    m = toxicity.fit(rows)
    assert m.score("you are an idiott and a morron 5") > 0.5 > m.score("calm weather") and m.score('she said the word "idiot" again') < m.score("you idiot moron")
    assert m.score("you odiot and oron") > 0.5
    # quoting never raises a score, and the weights have the signs that say so
    assert m.score('he said "idiot" and "moron" here') <= m.score("he and here") and all(w * s >= 0 for w, s in zip(m.weights, toxicity.SIGNS))
    plain = toxicity.ToxicityModel({"idiot": 9.0})
    quoted = lambda text: [h[3] for h in plain.hits(text)[1]]
    assert quoted('the "idiot" line') == quoted("they wrote idiot there") == quoted('the "old idiot of" line') == [True]
    assert quoted("don't be an idiot, it's fine") == quoted("you said nothing, you idiot") == quoted('"quiet" idiot "now"') == [False]


def test_toxicity_is_spread(spark, corpus):
    """The fit of many tasks is the fit of one."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("text", F.lit("clash"))
    some = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] in (0, 1)}
    rows = sorted((r["doc_id"], r["text"] or "", some[r["doc_id"]]) for r in corpus.collect() if r["doc_id"] in some)
    a, b = toxicity.fit([(t, y) for _, t, y in rows]), toxicity.fit_toxicity(corpus.repartition(5), labels)
    assert (a.families, a.known, a.near, a.left_out) == (b.families, b.known, b.near, b.left_out) and a.terms == pytest.approx(b.terms) and a.weights == pytest.approx(b.weights, abs=1e-6)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(corpus, b).collect()}
    for d, t, _ in rows[:50]:  # the score written out
        n, hits = b.hits(t)
        plain = [(h, b.near.get(h[1], 0.5) if h[2] else 1.0 if h[1] in b.terms else b.families[h[1]][1]) for h in hits if not h[3]]
        odds = {h[1]: b.terms.get(h[1]) or b.families[h[1]][0] for h, _ in plain}
        over, kinds = [], 0
        for edits in (False, True):
            some = [(h[1] if h[1] in b.terms else h[0], x) for h, x in plain if (h[2] > 0) == edits]
            over.append(max(0, sum(x for _, x in some) - 1))
            kinds += max(0, sum({k: max(x for g, x in some if g == k) for k, _ in some}.values()) - 1)
        mean = sum(odds[h[1]] * x for h, x in plain) / max(sum(x for _, x in plain), 1e-9)
        x = [1, *(math.log1p(v) for v in (sum(over) * mean, *over, sum(x for h, x in plain if h[4] and h[1] in b.terms)))]
        x += [kinds / 10, min(1, 20 * sum(over) / (n + 1)), math.log1p(len(hits) - len(plain))]
        assert abs(scores[d] - 1 / (1 + math.exp(-max(-30, min(30, sum(w * v for w, v in zip(b.weights, x))))))) < 1e-9


def test_factorisation_machine():
    """Scores are those of all pairs written out."""
    rng = np.random.default_rng(2)
    texts = ["good words here and there", "bad ### $$$ bad", "", "some more of it\nand a line", "x"]
    column = textio.binary_column(pa.array(texts))
    m = quality_fm.Machine()
    m.w, m.w0, m.fitted = rng.normal(0, 0.3, m.w.shape).astype(np.float32), np.float32(0.2), True
    m.v = rng.normal(0, 0.3, m.v.shape).astype(np.float32)
    for i, s in enumerate(m.score(column)):
        row, f, x = quality_fm.features(column.slice(i, 1))
        z = float(m.w0) + sum(float(m.w[a]) * b for a, b in zip(f, x)) + sum(float(m.v[f[a]] @ m.v[f[b]]) * x[a] * x[b] for a, b in itertools.combinations(range(len(f)), 2))
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-4


def test_quality_is_spread(spark, corpus):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    rows = sorted((r["doc_id"], r["text"] or "", some[r["doc_id"]]) for r in corpus.collect() if r["doc_id"] in some)
    a = quality_fm.Machine().fit(textio.binary_column(pa.array([t for _, t, _ in rows])), np.array([y for *_, y in rows], np.float32))
    b = quality_fm.fit_quality(corpus.repartition(5), labels)
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_classifiers_empty_tables(spark):
    empty, labels = documents(spark, EDGE).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs in (empty, documents(spark, EDGE).withColumn("score", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("label", F.lit(1))):
        n = docs.count()
        assert quality_fm.score_quality(docs, quality_fm.fit_quality(docs, labels)).count() == n
        assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).count() == n
        kept = toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, labels))
        assert kept.columns == docs.columns and kept.count() == n and quality_rules.keep_good(docs).columns == docs.columns and quality_rules.keep_good(docs).count() == 0
        assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs).count() == (n and 5)
        assert quality_rules.quality_rules(docs).count() == n and piece_lattice.encoding_digests(docs).count() == n
        assert simhash.simhash_components(docs).count() == n and packing.pack(docs).count() == (n and packing.pack(docs).count())


# 5


def test_quality_rules(spark):
    good = "This is a plain sentence of ordinary prose that ends well. " * 9
    assert quality_rules.measure(good.replace("plain", "quite plain")[:50])[5]
    distinct = " ".join(f"word{i} goes here," for i in range(40)) + " done."
    assert quality_rules.measure(distinct)[-1]
    assert not quality_rules.measure("\n".join(f"a{i} | b{i} | c{i} |" for i in range(40)))[-1]
    assert quality_rules.repeated_words("a b c a b c d".split()) == 6 and quality_rules.repeated_words("a a a a".split()) == 4
    out = {(r["doc_id"], r["n_words"]) for r in quality_rules.quality_rules(documents(spark, EDGE)).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 30000), (None, 3), (6, 1), (7, 3)} == out
    assert quality_rules.keep_good(documents(spark, EDGE)).count() == 0


def test_failing_lines_go(spark):
    """A kept document goes on without its failing lines; the verdict counts them as before."""
    good = [f"Alpha{i} is here, beta{i} was there, gamma{i} ends well." for i in range(12)]
    text = "\n".join(["Home", good[0], "", "All rights reserved.", *good[1:], "# $ % & | < >"])
    want = "\n".join([good[0], "", *good[1:]])
    docs = documents(spark, [(1, text), (2, "Home"), (3, None)])
    kept = quality_rules.keep_good(docs).collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in kept] == [(1, want, len(want))]
    got = {r["doc_id"]: (r["text"], r["lines_removed"], r["kept"]) for r in quality_rules.quality_rules(docs).collect()}
    assert got == {1: (want, 3, True), 2: ("", 1, False), 3: (None, 0, False)}
    assert "text" not in queries()["op5_quality_rules"](spark, SF).columns


# 6


def test_html():
    page = lambda body, extra="": f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>a</li><li>b</li></ul></nav><article><h1>Title {body}</h1><p>One &amp; {body}<br>two<p>three</article>{extra}<footer>f</footer>"
    wrapper = html_wrapper.infer([page(f"x{i}", "<div class='comments'><p>no</p></div>" if i % 2 else "") for i in range(5)])
    assert html_wrapper.extract(page("y"), wrapper) == "Title y\n\nOne & y two\n\nthree"
    plain = lambda story: f"<body><div class=top>Site</div><div id=content><p>{story}</p></div><div>Terms &amp; Notes</div></body>"
    wrapper = html_wrapper.infer([plain(f"story {i} text that differs {i * i}") for i in range(5)])
    assert html_wrapper.extract(plain("new story"), wrapper) == "new story"
    assert html_wrapper.extract("") == "" and html_wrapper.extract("a < b") and html_wrapper.extract("<div><p>open <b>x") == "open x"


def test_html_wrapper_decides():
    """Where tags and class words mislead, the slots of the host's pages tell the main text."""
    # names around the main text are not judged, nor are those that merely hold a dropped word
    for around in ("<body class='single has-sidebar'><article><p>%s</p></article>", "<body><article><div class='content-with-sidebar'><p>%s</p></div></article>", "<body><div id='page-header-wrapper'><div id=a><p>%s</p></div></div>"):
        assert html_wrapper.extract(around % "the story") == "the story"
    assert html_wrapper.extract("<html><head><title>t<body><article><p>the story</p></article>") == "the story"
    assert html_wrapper.extract("<head><meta charset=x><body><article><p>a</p><p class='reply-quote'>b</p><p class=ad>c<p>d<textarea><p>e</article>") == "a\n\nb\n\nd\n\ne"
    # cards in <article>, the text in a plain container, a notice inside it that all pages have, and no heading lost
    page = lambda i: f"<body><article class=card>Card {i % 7}</article><div id=wrap><h1>Head {i}</h1><div class=text><p>{'long story %d ' % i * 9}</p><address>As always, be kind.</address><p>{'more of %d ' % i * 5}</p></div></div><div class='site-comments'><p>{'nonsense %d ' % i * 20}</p></div>"
    wrapper = html_wrapper.infer(list(map(page, range(6))))
    assert html_wrapper.main_container(wrapper) == ">div.wrap" and html_wrapper.extract(page(9), wrapper).split("\n\n") == ["Head 9", ("long story 9 " * 9).strip(), ("more of 9 " * 5).strip()]
    # copies of one page do not make its text template; a page of another kind is read by itself
    assert html_wrapper.extract(page(1), html_wrapper.infer([page(1)] * 5)).count("long story") == 9
    assert html_wrapper.extract("<body><table><tr><td>elsewhere</td></tr></table>", wrapper) == "elsewhere"


def test_html_wrapper_covers_its_pages():
    """The expression matches each page it was made of, whatever their order; alignments are longest common subsequences."""
    rng = random.Random(12)

    def expression(nodes):
        part = lambda x: re.escape(html_wrapper._key(x)) + " " if x[0] in "tx" else f"(?:{expression(x[1])}){x[0]}"
        return "".join(map(part, nodes))

    def page():
        out = "<body><ul>" + "".join(f"<li>{rng.randint(0, 9)}</li>" for _ in range(rng.randint(0, 4))) + "</ul>"
        out += "".join(rng.choice(["<p>x%d</p>", "<div class=a>%d</div>", "<h2>%d</h2><p>y</p>", "<section><p>%d</p></section>"]) % rng.randint(0, 99) for _ in range(rng.randint(1, 5)))
        return out + rng.choice(["", "<footer>f</footer>"])

    for _ in range(150):
        pages = [page() for _ in range(rng.randint(1, 6))]
        wrapper = html_wrapper.infer(pages)
        assert wrapper == html_wrapper.infer(rng.sample(pages, len(pages)))
        for p in pages:
            assert re.fullmatch(expression(wrapper), "".join(html_wrapper._key(x) + " " for x in html_wrapper.Page(p).nodes)), (p, wrapper)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
        return row[-1]

    for _ in range(100):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert len(html_wrapper._matches(a, b)) == longest(a, b)


def test_html_long_menus():
    """What stands behind a long menu still counts, whether the menu folds or not; long streams lose no node."""
    for name in (lambda i, k: f"menu-item-{k}", lambda i, k: "m" + "".join(chr(97 + int(c)) for c in str(k))):
        page = lambda i: "<body><div id=topbar>Day %d, at length and in words</div><div id=list>%s</div><article><p>story %d of its own</p></article></body>" % (i, "".join(f"<li id='{name(i, k)}'>item {k}</li>" for k in range(200)), i)  # noqa: E731, B023
        assert html_wrapper.extract(page(9), html_wrapper.infer([page(i) for i in range(4)])) == "story 9 of its own"
    rng = random.Random(3)
    a, b = ([["t", rng.choice("abcdefgh") * rng.randint(1, 4)] for _ in range(n)] for n in (900, 1100))
    names = lambda nodes: Counter(x[1] for x in nodes if x[0] == "t") + sum((Counter(y[1] for y in x[1]) for x in nodes if x[0] == "?"), Counter())
    merged = html_wrapper.align(a, b)
    assert all(names(merged)[k] >= max(names(a)[k], names(b)[k]) for k in names(a) | names(b))
    keys = [x[1] for x in a], [x[1] for x in b]
    pairs = html_wrapper._matches(*keys)
    assert all(keys[0][i] == keys[1][j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs)) and len(pairs) > 200
    for bad in ("<svg" * 20_000, "<p title='" * 20_000, "<svg>" * 20_000, "<" * 50_000, "<div>" * 20_000, "<!--" * 20_000):
        began = time.perf_counter()
        html_wrapper.extract(bad)
        assert time.perf_counter() - began < 20


def test_html_pages(spark):
    rows = [(i, f"http://h{i % 2}.x/{i}", f"<body><nav>m</nav><article><p>text {i}</p></article></body>") for i in range(9)] + [(20, None, None), (21, "nohost", "plain"), (8, "http://h0.x/8", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumn("host", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_wrapper.extract_pages(df).collect()]
    assert Counter(got) == Counter([(i, f"text {i}", 6) for i in range(9)] + [(20, "", 0), (21, "plain", 5), (8, "", 0)])
    assert html_wrapper.extract_pages(df.limit(0)).count() == 0


def test_html_any_partitioning(spark, monkeypatch):
    """The same texts from one task and from many, with wrappers broadcast or joined, and with a host's shapes aligned in several rounds."""
    rng = random.Random(7)
    parts = ["<p>x{}</p>", "<div class=a>{}</div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<section>{}</section>", "<blockquote>{}</blockquote>"]
    rows = [(i, f"http://{'hot' if i % 3 else 'h%d' % (i % 5)}.x/{i}", "<body><nav>n</nav><div id=c>" + "".join(rng.choice(parts).format(f"word {rng.randint(0, 10**6)} and so on") for _ in range(rng.randint(1, 9))) + "</div><p>Same</p>") for i in range(240)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_wrapper.extract_pages(df.coalesce(1)).collect()))
    assert all("Same" not in r[2] and r[2].count("word") >= 1 for r in want)
    monkeypatch.setattr(html_wrapper, "HELD_SHAPES", 3)
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, html_wrapper.extract_pages(df.repartition(7)).collect())) == want


# 7


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    x = (centers[rng.integers(0, 12, 4000)] + 0.3 * rng.normal(size=(4000, 16))).astype(np.float32)
    x[:400] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(df, lambda i: i % 100 == 0).collect()
    d = x.astype(float)
    hits = 0
    for q in range(0, 4000, 100):
        score = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        score[q] = np.inf
        want = np.lexsort((np.arange(4000), score))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert len(mine) == 10 and [r[0] for r in mine] == list(range(1, 11)) and all(abs(s - score[v]) < 1e-12 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(want.tolist()))
        if q < 400:
            assert [v for _, v, _ in mine] == want.tolist()
    short = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df.unionByName(spark.createDataFrame([(5400, [2.0]), (5400, [3.0]), (5401, [2.5]), (0, rows[7][1])], df.schema)), lambda i: i % 100 == 0).collect()]
    # each row of a repeated query id has its own ranks; a query's candidates have its length
    assert sorted(x for x in short if x[0] in (5300, 5400)) == [(5300, 1, 5400), (5300, 2, 5401), (5300, 3, 5400), (5400, 1, 5401), (5400, 1, 5401), (5400, 2, 5300), (5400, 2, 5300)]
    assert Counter(x[1] for x in short if x[0] == 0) == {k: 2 for k in range(1, 11)}
    assert hits >= 0.9 * 400 and neighbours.search(df.limit(0), lambda i: i % 100 == 0).count() == 0


# 8


def test_tokens_equal_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.WordTokenizer()
    rng = random.Random(4)
    samples = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "it's  we'll", "x <|endoftext|> y", "tab\t and nbsp", "日本 語 😀", "a" * 300, "1 22 333 ½ ²", "é   z "]
    samples += ["".join(rng.choice("ab 1'\n\té日.,!") for _ in range(60)) for _ in range(300)]
    for s in samples * 2:
        assert np.frombuffer(mine.encode(s), "<u4").tolist() == exact.encode(s, add_special_tokens=False).ids, repr(s)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan(score):
    rng = random.Random(6)
    for cap in (packing.Capacities(score=score), packing.Capacities(tokens=100, documents=5, attention=6000, score=score)):
        top = 1024 if cap.tokens == 1024 else 70
        histogram = Counter(rng.randint(1, top) for _ in range(3000))
        bins, seen = defaultdict(list), Counter()
        for length, a, b, first, each, at in packing.plan(histogram, cap):
            for r in range(a, b):
                bins[first + (r - a) // each].append((at + (r - a) % each * length, length))
                seen[length] += 1
        assert seen == histogram and sorted(bins) == list(range(len(bins)))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == list(itertools.accumulate([0] + [n for _, n in b[:-1]]))
            assert sum(n for _, n in b) <= cap.tokens and len(b) <= cap.documents and sum(n * n for _, n in b) <= cap.attention
        if cap.tokens == 1024:
            assert len(bins) <= 1.02 * math.ceil(sum(k * v for k, v in histogram.items()) / 1024) + 1


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_is_best_fit(score):
    """The plan by intervals against best-fit decreasing a piece at a time, under capacities that all bind."""
    rng = random.Random(11)
    for cap in (packing.Capacities(tokens=100, documents=4, attention=4000, weights=(1.0, 0.7, 0.4), score=score), packing.Capacities(tokens=64, documents=64, attention=64 * 64, score=score)):
        full = (cap.tokens, cap.documents, cap.attention)
        for _ in range(20):
            lengths = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 150))), reverse=True)
            bins = []
            for n in lengths:
                need = (n, 1, n * n)
                fits = [b for b in bins if all(a <= c for a, c in zip(need, b))]

                def worth(b, need=need):
                    if score == "dot":
                        return -sum(w * x / c * y / c for w, x, y, c in zip(cap.weights, need, b, full))
                    return sum(w * ((y - x) / c) ** 2 for w, x, y, c in zip(cap.weights, need, b, full))

                chosen = min(fits, key=worth) if fits else None
                if chosen is None:
                    bins.append(chosen := list(full))
                for i, x in enumerate(need):
                    chosen[i] -= x
            used = {first + j for _, a, b, first, each, _ in packing.plan(Counter(lengths), cap) for j in range(-(-(b - a) // each))}
            assert abs(len(used) - len(bins)) <= max(1, 0.03 * len(bins))


def test_pack(spark, corpus, texts):
    got = packing.pack(documents(spark, list(texts.items()) + [(9000, None), (9001, "")])).collect()
    tok = packing.WordTokenizer()
    for d, t in [*texts.items(), (9000, None)]:
        ids = tok.encode(t or "") + b"\x02\0\0\0"
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(ids) // 4 and all(r["length"] == 1024 for r in mine[1:])
        for r in mine:
            assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in by.values():
        b.sort()
        assert [o for o, _ in b] == list(itertools.accumulate([0] + [n for _, n in b[:-1]])) and sum(n for _, n in b) <= 1024
    assert len(by) <= 1.02 * math.ceil(sum(r["length"] for r in got) / 1024) + 1
    assert packing.pack(documents(spark, EDGE).limit(0)).count() == 0


# 9


def test_piece_lattice(spark):
    m = piece_lattice.PieceLattice()

    def brute(text, n):
        s, out = m.escape(text), []

        def walk(at, score, ids):
            if at == len(s):
                out.append((score, ids))
            for end in range(at + 1, len(s) + 1):
                p = s[at:end]
                if p in m.pieces:
                    walk(end, score + m.scores[p], [*ids, m.pieces[p][0]])
                elif end == at + 1:
                    walk(end, score + m.missing, [*ids, *m.ids(p)])

        walk(0, 0.0, [])
        return sorted(out, key=lambda x: -x[0])[:n]

    rng = random.Random(8)
    texts = ["hello we", "a  b c", "été 日😀", "the cat s", "x", "aaaaaa", "zq\n\tk", " a ", "a▁b", "no no no", *("".join(rng.choice("ab e\n%") for _ in range(11)) for _ in range(20))]
    for text in texts:
        for n in (1, 2, 4, 7):
            mine, want = m.encodings(text, n), brute(text, n)
            assert [round(s, 3) for s, _ in mine] == [round(s, 3) for s, _ in want], text
            assert all(m.decode(ids) == text.replace("▁", " ") for _, ids in mine) and len({tuple(i) for _, i in mine}) == len(mine)
            assert [round(s, 3) for s, _ in m.search(m.escape(text), n)] == [round(s, 3) for s, _ in want]
    assert m.encodings("", 4) == [(0.0, [])]


def test_piece_documents(spark):
    df = documents(spark, EDGE)
    out = piece_lattice.encoding_digests(df.withColumn("ids", F.lit("clash")).withColumn("a.b", F.lit(1))).collect()
    assert len(out) == len(EDGE) and all(r["round_trip"] for r in out)
    for r in out:
        assert len(r["best_scores"]) == len(r["best_crc32"]) == len(r["best_pieces"]) == r["n_best"] and r["best_scores"] == sorted(r["best_scores"], reverse=True)
        assert (r["score"], r["n_pieces"], r["ids_crc32"], r["last_score"]) == (r["best_scores"][0], r["best_pieces"][0], r["best_crc32"][0], r["best_scores"][-1])
    encoded = piece_lattice.encode_documents(df)
    found = {(r["doc_id"], r["n_best"][0]["score"]): [zlib.crc32(np.array(x["ids"], "<u4").tobytes()) for x in r["n_best"]] for r in encoded.collect()}
    assert found == {(r["doc_id"], r["score"]): r["best_crc32"] for r in out}
    texts = piece_lattice.decode_documents(encoded.select("doc_id", F.col("n_best")[0]["ids"].alias("ids"))).collect()
    assert Counter((r["doc_id"], r["text"]) for r in texts) == Counter((d, t or "") for d, t in EDGE)
    assert piece_lattice.encoding_digests(df.limit(0)).count() == 0


def test_pieces_of_the_library():
    """The library merges by rank, so its ids differ; decoding reads them all the same, and no segmentation scores above ours."""
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    m = piece_lattice.lattice()
    for text in ["hello world and more", "Über 日本 😀 été", "a b  c", "The quick brown fox jumps."]:
        ids = library.encode(text)
        assert m.decode(ids) == text
        score = sum(m.pieces[library.id_to_piece(i)][1] for i in ids) if not any(map(library.is_byte, ids)) else -math.inf
        assert m.encodings(text, 1)[0][0] >= score


def test_pieces_without_spaces():
    """A unit of very many tied paths ends, and so does a text of very many units."""
    m = piece_lattice.lattice()
    for text in ("x" * 50_000, "ab" * 30_000, "日本" * 30_000, "aGVsbG8" * 9_000):
        began = time.perf_counter()
        found = m.encodings(text, 4)
        assert time.perf_counter() - began < 15 and all(m.decode(ids) == text for _, ids in found)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = corpus_pipeline.run(spark, SF)
    have = {r["doc_id"] for r in placed.select("doc_id").distinct().collect()}
    one = {r["doc_id"]: r["text"] for r in docs.collect() if quality_rules.measure(r["text"])[-1]}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs.where(F.col("doc_id").isin(*one)), labels, keep=lambda d: remainder(d, 4) != 2)
    two = {d: t for d, t in one.items() if model.score(t) < 0.3}
    gone = brute_lines(list(two.items()))
    three = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in two.items()}
    three = {d: t for d, t in three.items() if not gone[d] or WORD.search(t)}
    fps = {d: brute_fingerprint(t) for d, t in three.items()}
    roots = closed(set(fps.values()))
    four = {}
    for d in sorted(fps):
        four.setdefault(roots[fps[d]], d)
    assert have == set(four.values())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_edges(spark, tmp_path):
    """Null, empty, very long and repeated texts, and an empty table, go through all stages."""
    import corpus_pipeline

    story, other = (" ".join(f"{a}{i} met {a}{i + 1}x near {a}{i + 2}y." for i in range(0, 120, 3)) for a in ("word", "sign"))
    for name, rows in (("some", [*EDGE, (9, story), (9, story), (10, story + " Twice."), (11, other)]), ("none", [])):
        where = str(tmp_path / name)
        documents(spark, rows).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(9, 1, 0), (6, 0, 1)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        out = corpus_pipeline.run(spark, where).collect()
        assert {"doc_id", "piece", "sequence_id"} <= set(corpus_pipeline.run(spark, where).columns)
        assert ({r["doc_id"] for r in out} & {9, 11} == {9, 11}) if rows else not out


def test_line_dedup_own_names(spark):
    """Columns named as the operator's own helpers, in any case, come through unchanged."""
    long_line = "one line that is long enough to be compared"
    names = ["all_lines", "gone_rk", "gone_did", "Gone_Lines", "did", "txt", "rk", "first"]
    df = documents(spark, [(1, long_line), (2, f"{long_line}\nx")]).withColumn("N_Lines", F.lit("old"))
    out = line_dedup.line_dedup(df.select("*", *(F.lit(f"kept {n}").alias(n) for n in names)))
    assert [c for c in out.columns if c.lower() == "n_lines"] == ["n_lines"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert {n: {r[n] for r in rows.values()} for n in names} == {n: {f"kept {n}"} for n in names}
    assert (rows[1]["text"], rows[2]["text"], rows[2]["removed_lines"]) == (long_line, "x", [0])


def test_count_filter_of_postings(spark):
    """Shared lists count shared bytes, and the filter drops the candidates that share fewer than six."""
    rng = random.Random(9)
    assert len(simhash.QUADRUPLES) == 14
    for n, lists in ((8, 14), (7, 7), (6, 3)):
        for same in itertools.combinations(range(8), n):
            assert sum(set(q) <= set(same) for q in simhash.QUADRUPLES) == lists
    assert all(sum(set(q) <= set(same) for q in simhash.QUADRUPLES) <= 1 for same in itertools.combinations(range(8), 5))
    fps = {rng.getrandbits(64) for _ in range(300)}
    for x in sorted(fps)[:150]:
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        fps.add(int.from_bytes(bytes(b if i in rng.sample(range(8), 5) else rng.randrange(256) for i, b in enumerate(x.to_bytes(8, "little"))), "little"))
        fps.add(x & 0xFFFFFFFF | rng.getrandbits(32) << 32)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {(r["a"] % (1 << 64), r["b"] % (1 << 64)): r["lists"] for r in simhash.candidate_pairs(simhash.posting_lists(df)).collect()}
    for (a, b), lists in found.items():
        same = {i for i in range(8) if a >> 8 * i & 255 == b >> 8 * i & 255}
        assert lists == sum(set(q) <= same for q in simhash.QUADRUPLES) and (lists >= 3) == (len(same) >= 6)
    kept = {p for p, lists in found.items() if lists >= simhash.MIN_LISTS}
    assert len(kept) < len(found) and {frozenset(p) for p in kept} >= {frozenset((a, b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}


def test_keep_one_repeated_ids(spark):
    """An id with texts of two components keeps both; equal rows and copies under one id keep one."""
    a, b = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight")
    df = documents(spark, [(3, a), (5, a), (5, b), (5, b), (6, b), (7, None), (7, ""), (8, ""), (None, a), (None, a)])
    out = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=repr)
    assert [x for x in out if x[0] != 7] == sorted([(3, a), (5, b), (None, a), (None, a)], key=repr)
    assert sum(x[0] == 7 for x in out) == 1


def test_training_rows_repeated_id(spark):
    """A labelled id with very many rows is one training row."""
    df = documents(spark, [(1, f"text {i:03}") for i in range(200)] + [(2, None), (3, "unlabelled")])
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(df, labels, "toxic", lambda d: F.lit(True), "doc_id", "text", 10).collect()
    assert sorted(map(tuple, rows)) == [(1, "text 000", 1), (2, "", 0)]


def test_quality_features_are_bounded():
    """A text of very many different words has a feature a bucket at most, of the same weight in all; scripts are told apart."""
    texts = [" ".join(f"w{i}" for i in range(200_000)), "a b a", "слово и слово", "言葉 と 言葉", None]
    row, feature, x = quality_fm.features(textio.binary_column(pa.array(texts)))
    for i in range(len(texts)):
        own = feature[row == i]
        assert len(set(own.tolist())) == len(own) <= quality_fm.N_FEATURES
        words = own < quality_fm.BUCKETS
        assert words.sum() <= quality_fm.BUCKETS
    assert abs(float(x[(row == 0) & (feature < quality_fm.BUCKETS)].sum()) - 200_000 / math.sqrt(200_000)) < 0.1
    scripts = [tuple(feature[(row == i) & (feature >= quality_fm.BUCKETS + 14 * quality_fm.BINS)].tolist()) for i in range(4)]
    assert len(set(scripts)) == 3 and scripts[0] == scripts[1]
