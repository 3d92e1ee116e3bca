"""Importance resampling, prefix tries and chat formatting against brute force, and their defined edge cases."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probeforge.llm import chat_format, importance, prefix_trie
from probeforge.llm.queries import queries

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# 11


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def grams(text, max_n):
    w = word_list(text)
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute_importance(docs, target, percent, min_words, max_n, buckets, seed):
    def counted(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t, max_n))

    s, t = counted(x for _, x in docs), counted(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        g = grams(x, max_n)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in g)
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(g), weight, None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r, (d, x) in zip(rows, docs) if d is not None and len(word_list(x)) >= min_words), key=lambda r: (-r[3], r[0]))
    for r in rows:
        r.append(None)
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r) for r in rows]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("max_n", [1, 3])
def test_importance(spark, max_n):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_importance(docs, target, 10, 20, max_n, 997, 7)
    got = importance.importance_ranks(spark.createDataFrame(docs, KIND).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), 10, 20, max_n, 997, 7)
    got = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_crc_algebra():
    rng = random.Random(3)
    for _ in range(100):
        a, b = rng.randbytes(rng.randrange(60)), rng.randbytes(rng.randrange(5000))
        assert importance.combined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))[0] == zlib.crc32(a + b)


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_gram_crcs_of_sliced_texts(size, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", size)
    texts = ["Hello World 12ab é-x É", None, "", "a b c d e f g h i j k " * 30, "A!" * 5, "x" * 3000 + " y", " - "]
    for max_n in (1, 2, 4):
        got = defaultdict(list)
        for rows, crcs, _ in importance.features(pa.array(texts), max_n):
            for a, c in zip(rows.tolist(), crcs.tolist()):
                got[a].append(c)
        for i, t in enumerate(texts):
            assert sorted(got[i]) == sorted(zlib.crc32(g.encode()) for g in grams(t, max_n)), (i, max_n)


def test_importance_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b " * 40), (3, "a b " * 40), (3, "a b " * 40), (None, "a b " * 40), (5, "word " * 300_000), (6, "zz " * 30), (7, " \n "), (-8, "a b c d " * 6)]
    target = [("a b a b",), (None,)]
    want = brute_importance(docs, [t for (t,) in target], 50, 20, 2, 10_000, 2024)
    frame = spark.createDataFrame(docs, KIND).withColumn("rank", F.lit("clash")).withColumn("a.b", F.lit(1)).withColumn("score", F.lit(2)).repartition(4)
    bench = spark.createDataFrame(target, "text string")
    got = importance.importance_ranks(frame, bench, percent=50)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=key) == sorted(want, key=key)
    drawn = importance.importance_resample(frame, bench, percent=50)
    assert drawn.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in drawn.collect()) == Counter((d, x) for (d, x), w in zip(docs, want) if w[4])
    assert importance.importance_ranks(frame.limit(0), bench).count() == 0 and importance.importance_resample(frame.limit(0), bench).count() == 0
    assert importance.importance_ranks(frame, bench.limit(0)).count() == len(docs)


def test_equal_scores_are_spread(spark):
    """A third of the rows with one score and id does not fall to one range."""
    rows = [(7, 30, 30, 5, 99)] * 4000 + [(i, 30, 30, 5, i % 500) for i in range(8000)]
    scores = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(4)
    got = importance.ranked(scores, 10, 20)
    ranks = [(r["rank"], r["score"], r["doc_id"]) for r in got.where("rank is not null").collect()]
    assert sorted(r[0] for r in ranks) == list(range(1, 1201)) and got.count() == 12_000
    assert [r[1:] for r in sorted(ranks)] == [(s, d) for s, d in sorted(((r[4], r[0]) for r in rows), key=lambda x: (-x[0], x[1]))[:1200]]


# 12


def brute_trie(conversations, rebuild=True):
    by = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(rows)] for c, rows in by.items()}

    def built(c):
        if not rebuild:
            return own[c]
        h = zlib.crc32(str(c).encode()) % 4
        return own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]

    seqs = {c: tuple(built(c)) for c in own}
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    below = defaultdict(list)
    for s in members:
        for d in range(len(s) + 1):
            below[s[:d]].append(s)
    out = []
    for s, cs in members.items():
        words = {x: (len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0 for x in below[s]}
        kids = [x for x in below[s] if len(x) == len(s) + 1]
        leaves = [x for x in below[s] if not any(len(y) > len(x) for y in below[x])]
        ends = ",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(s))))
        out.append((min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), len(kids), len(leaves), sum(words.values()), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=key)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONV = "conv_id long, turn long, role string, text string"


def trie_of(frame, rebuild=True):
    turns = prefix_trie.numbered_turns(frame)
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_openings(turns) if rebuild else prefix_trie.with_roots(turns))
    return sorted((tuple(r) for r in got.select(*TRIE).collect()), key=key)


def test_trie(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert trie_of(frame) == brute_trie(rows)


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_random(spark, rebuild, monkeypatch):
    """Short alphabets give deep sharing; ids of both signs, gaps, equal conversations, ties and nulls."""
    rng = random.Random(rebuild)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    rows = []
    for c in [*range(-45, 70), 9000, 9001]:
        for i in range(rng.choice([1, 2, 3, 5, 9, 17, 40])):
            rows.append((c, None if rng.random() < 0.05 else i, rng.choice(["u", "a", None]), rng.choice(["x y", "z", None]) if i % 3 else "same words here"))
    rows += [(c, i, "u", "copy of a text") for c in range(100, 160) for i in range(3)] + [(None, 0, "u", "x"), (3, 1, "u", "z"), (3, 1, "u", "z")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, CONV).withColumn("node", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(4)
    assert trie_of(frame, rebuild) == brute_trie(rows, rebuild)


def test_trie_edges(spark):
    assert trie_of(spark.createDataFrame([], CONV)) == [] and trie_of(spark.createDataFrame([(None, 0, "u", "x")], CONV)) == []
    # conversation 21 has no more own turns than it gives up, and no conversation 20 to take from: it is a member of the root only
    c = next(i for i in range(21, 40) if zlib.crc32(str(i).encode()) % 4 == 3)
    rows = [(c, 0, "u", "a"), (c, 1, "a", "b" * 100_000)]
    assert trie_of(spark.createDataFrame(rows, CONV)) == brute_trie(rows) and len(brute_trie(rows)) == 1


def test_trie_last_turns(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = prefix_trie.with_roots(prefix_trie.numbered_turns(frame, texts=True))
    got = prefix_trie.with_last_turn(prefix_trie.prefix_trie(turns), turns).collect()
    text = {(r["conv_id"], r["turn"] + 1): (r["role"], r["text"]) for r in frame.collect()}
    assert len(got) > 50 and all((r["role"], r["text"]) == text.get((r["conv_id"], r["depth"]), (None, None)) for r in got)


# 13

CHATS = [
    ("messages", {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 4}, [("user", "a"), ("assistant", "b")]),
    ("messages", {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "c"}]}, {"role": "assistant", "content": None}]}, [("user", "ac"), ("assistant", "")]),
    ("messages", {"messages": []}, []),
    ("share", {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ("instruction", {"instruction": "a", "input": "x", "output": "b"}, [("user", "a\n\nx"), ("assistant", "b")]),
    ("instruction", {"instruction": "a", "output": "b", "source": {"url": "u"}}, [("user", "a"), ("assistant", "b")]),
    ("prompt", {"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
    ("response", {"system": "s", "prompt": "a", "response": "b"}, [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ("question", {"system_prompt": "s", "question": "a", "response": "b"}, [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ("history", {"history": [["a", "b"], ["c", "d"]], "query": "e", "response": "f"}, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e"), ("assistant", "f")]),
    ("turns", {"turns": [{"role": "x:y", "text": "a"}]}, [("x:y", "a")]),
    (None, {"title": "a", "body": ["b"]}, []),
    (None, {}, []),
]


def test_layouts():
    table = chat_format.LayoutTable()
    for name, record, turns in CHATS:
        assert table.turns(json.dumps(record))[1:] == (name, turns), record
    for bad in (None, "", "[1]", "{broken", '{"messages": 3}', '{"messages": [3]}'):
        assert table.turns(bad)[1:] == (None, []), bad
    # the order of fields and the values play no part in the fingerprint, a further field does
    a, b, c = ({"x": 1, "y": [{"z": "s"}, {"w": None}]}, {"y": [{"w": 2, "z": []}], "x": "t"}, {"x": 1, "y": [{"z": "s"}]})
    a, b, c = (chat_format.fingerprint(chat_format.field_paths(v)) for v in (a, {"y": [{"w": 2, "z": "q"}], "x": "t"}, c))
    assert a == b != c


def test_template_is_reversible():
    rng = random.Random(2)
    bits = ["### ", "</turn>", "\\", "\\e", ":", ": ", "\n", "</turn>\n", "### assistant: ", "é😀", "a", "#", "</turn", ">", "\\\\"]
    for _ in range(2000):
        turns = [("".join(rng.choices(bits, k=rng.randrange(4))) or rng.choice(["assistant", "user", ""]), "".join(rng.choices(bits, k=rng.randrange(8)))) for _ in range(rng.randrange(5))]
        text, spans = chat_format.formatted(turns)
        assert chat_format.parsed(text) == turns
        assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def brute_chat(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        said = [t for r, t in turns if r == "assistant"]
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(chat_format.formatted(turns)[0]))
    return out


def chats(frame):
    parts = chat_format.format_records(chat_format.as_records(frame))
    return {r[0]: tuple(r)[1:] for r in chat_format.read_back(parts).collect()}, parts


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "\\### Assistant: </turn> ok"
    want = brute_chat([*rows, (-7, 0, "user", text), (-7, 1, "assistant", text)])
    got = queries()["op13_chat_formatting"](spark, SF)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_chat_edges(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", None, "gpt", "a: b\n", "### "]
    rows = [(c, None if rng.random() < 0.1 else i, rng.choice(roles), rng.choice(["", None, "</turn>", "x" * 50, "a\\e", "ünï😀"])) for c in range(60) for i in range(rng.randrange(1, 6))]
    rows += [(70, i, r, "said") for i, r in enumerate(["user", "assistant"])] * 2 + [(71, i, "user", f"t{i}") for i in range(300)] + [(72, i, "assistant", "w" * 400_000) for i in range(9)]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, CONV).withColumn("part", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(6)
    got, parts = chats(frame)
    assert got == brute_chat(rows)
    found = parts.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("formatted")).alias("most"), F.collect_set("layout").alias("layouts"), F.sum("n_turns").alias("turns")).collect()
    found = {r["conv_id"]: r for r in found}
    assert found[71]["n"] == 5 and found[72]["n"] >= 3 and found[72]["most"] < 2_000_000 and len({x for r in found.values() for x in r["layouts"]}) >= 4
    assert chats(frame.limit(0))[0] == {}


def test_records_keep_their_columns(spark):
    rows = [(i, f"c{i}", json.dumps(r)) for i, (_, r, _) in enumerate(CHATS)] + [(None, None, None), (99, "again", json.dumps(CHATS[0][1])), (99, "again", json.dumps(CHATS[0][1]))]
    frame = spark.createDataFrame(rows, "`a.b` long, layout2 string, json string")
    out = chat_format.format_records(frame, "json")
    assert out.columns == ["a.b", "layout2", "fingerprint", "layout", "n_turns", "formatted", "loss_spans"]
    got = {r["layout2"]: r for r in out.collect()}
    for i, (name, _, turns) in enumerate(CHATS):
        assert got[f"c{i}"]["layout"] == name and chat_format.parsed(got[f"c{i}"]["formatted"]) == turns and got[f"c{i}"]["n_turns"] == len(turns)
    assert out.count() == len(rows) and got[None]["layout"] is None
