"""Quality rules, toxicity, decontamination, packing, archives, chat and HTML."""

import base64
import collections
import gzip
import hashlib
import json
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import decontaminate, html_text, packing, quality_rules, scan, tokens, tool_calls, toxicity, warc
from sluice.llm.html_text import visible_text



def statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics(docs, doc_rows):
    out = quality_rules.statistics(docs).collect()
    assert collections.Counter((r.doc_id, *(r[k] for k in quality_rules.BASE)) for r in out) == collections.Counter((r[0], *statistics(r[1] or "")) for r in doc_rows)


def test_rules_find_a_conjunction():
    r = np.random.default_rng(1)
    x = {"a": r.random(3000), "b": r.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = quality_rules.learn(x, bad)
    hit = np.any([k.holds(x) for k in rules], axis=0)
    assert (hit == bad).mean() > 0.98
    assert quality_rules.learn(x, np.zeros(3000, bool)) == []


def test_decision_against_brute_force(docs):
    """The ordered expression rejects what the first rule that holds rejects, on every row's own statistics."""
    t = quality_rules.Test
    rules = [quality_rules.Rule((t("words", True, 300.0), t("repeat_share", True, 0.5))), quality_rules.Rule((t("chars_per_word", False, 2.5),)), quality_rules.Rule((t("words_per_line", False, 3.0), t("short_line_share", True, 0.2)))]
    stats = quality_rules.statistics(docs)
    rows = stats.select(*quality_rules.STATS, quality_rules.decision(rules).alias("kept")).collect()

    def value(r, name):
        return eval(quality_rules.FEATURES[name], {"greatest": max, "double": float} | {k: r[k] for k in quality_rules.STATS})

    holds = lambda r, x: value(r, x.feature) > x.threshold if x.above else value(r, x.feature) <= x.threshold
    want = [not any(all(holds(r, x) for x in rule.tests) for rule in rules) for r in rows]
    assert [r.kept for r in rows] == want and len(set(want)) == 2
    assert {r.kept for r in stats.select(quality_rules.decision([]).alias("kept")).collect()} == {True}


def test_quality(spark, no_docs):
    good, junk = "plain words of an ordinary kind that say something new each time ", "## noise $$ and %% more && noise || here << or >> there ** too ### "
    rows = [(i, (good if i % 4 else junk) + str(i)) for i in range(200)] + [(900, None), (901, "too short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 4))) for i in range(200)] + [(5, None), (6, 0), (6, 1)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.quality(df, labels).collect()}
    assert all(kept[i] == bool(i % 4) for i in range(200)) and not kept[900] and not kept[901]
    assert quality_rules.quality(no_docs, labels).count() == 0
    assert quality_rules.quality(df, labels.limit(0)).where("kept").count() == 200


def test_toxicity(spark, no_docs):
    rows = [(i, ("you are a worthless idiot and a clown " if i % 2 else "the weather of this day is fine and calm ") * (1 + i % 7) + f"row {i}") for i in range(300)] + [(1000, None), (1001, ""), (None, "idiot")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(3, 0), (4, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [out[i].held_out for i in range(300)] == [i in held for i in range(300)]
    assert all(out[i].predicted == i % 2 for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert out[1000].score == out[1001].score
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(df, labels.limit(0)).collect()} == {0.5}


def test_toxicity_of_rare_words(spark):
    """A word of a small language counts, however many n-grams of the large one tell more."""
    r = np.random.default_rng(5)
    words = ["".join(chr(97 + k) for k in r.integers(0, 26, 8)) for _ in range(1200)]
    rows = [(i, " ".join(words[(i % 2) * 600 :][:600])) for i in range(120)] + [(i, "спокойный хороший день" if i % 2 else "вот глупый грубиян") for i in range(1000, 1060)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, int(i % 2 == (i < 1000))) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert (model.number >= 0).sum() > 8192
    assert (model.score(["вот глупый грубиян", "спокойный хороший день"]) >= 0.5).tolist() == [True, False]


def gram_counts(t):
    """Words and n-gram buckets of a text, one character at a time."""
    words, now = [], []
    for c in (t or "").lower() + "\n":
        if "a" <= c <= "z" or ord(c) >= 0xC0:
            now.append(ord(c))
        elif now:
            words.append([0, *now, 0])
            now = []
    out, cut = collections.Counter(), (1 << 64) - 1
    for w in words:
        for n in toxicity.SIZES:
            for i in range(len(w) - n + 1):
                h = sum((w[i + k] + 1) * int(toxicity._MULT[k]) for k in range(n)) * int(scan.MIX_A) & cut
                out[((h ^ h >> 31) * int(scan.GOLD) & cut) >> (64 - toxicity.BUCKET_BITS)] += 1
    return len(words), out


def test_grams_against_brute_force(doc_rows):
    texts = [r[1] for r in doc_rows if len(r[1] or "") < 3000]
    for window in (toxicity.WINDOW_CHARS, 50):
        g = toxicity.Grams(texts, window)
        for i, t in enumerate(texts):
            at = g.doc == i
            assert (g.words[i], dict(zip(g.bucket[at].tolist(), g.count[at].tolist(), strict=True))) == gram_counts(t)


def test_log_count_ratios():
    got = toxicity.log_count_ratios(np.array([0, 5, 9]), np.array([7, 5, 0]), 10, 8)
    assert np.allclose(got, [np.log((7 + 1) / 10 * 12 / 1), np.log((6 / 10) / (6 / 12)), np.log((1 / 10) / (10 / 12))], atol=1e-6)


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_contamination(spark, docs, doc_rows, no_docs):
    words = alnum(doc_rows[7][1])
    items = [(1, " ".join(words[3:20])), (10, " ".join(words[5:18]).upper()), (2, "hello THERE"), (3, None), (4, "..."), (None, "a"), (5, "not in any text at all"), (1, " ".join(words[3:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = alnum(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = collections.Counter()
    for r in doc_rows:
        w, hit, found = alnum(r[1]), set(), set()
        for g, who in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= who
        want[(r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    out = decontaminate.contamination(docs, bench)
    assert collections.Counter(tuple(r) for r in out.drop("items").collect()) == want
    assert sum(n for k, n in want.items() if k[5]) >= 5
    left = decontaminate.decontaminate(docs, bench)
    assert left.count() == sum(n for k, n in want.items() if not k[5] or k[0] is None)
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert not decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count()


def test_proximity(spark):
    index = decontaminate.build_index(spark.createDataFrame([(1, "red fox jumps over a blue hill"), (2, "blue x x x x x red"), (3, "red"), (4, "blue")], "doc_id long, text string"))
    near = decontaminate.proximity_matches(index, [("q", "red blue")], 5).collect()
    assert {r.doc_id for r in near} == {1}
    assert {r.doc_id for r in decontaminate.proximity_matches(index, [("q", "red blue")], 6).collect()} == {1, 2}


def test_query_blocks(spark):
    """Every window of an item stands in some block, however the words are cut."""
    texts = {"a": "a b c d e", "b": " ".join(f"w{i}" for i in range(23)), "c": "one", "d": "", "e": None}
    bench = spark.createDataFrame([*texts.items(), (None, "x y")], "item_id string, text string").coalesce(1)
    want = {}
    for i, t in texts.items():
        h = decontaminate._words(t)
        n = min(4, len(h))
        want[i] = {h[k : k + n].tobytes() for k in range(len(h) - n + 1 if n else 0)}
    for most in (4, 7, 1000):
        got = {i: set() for i in texts}
        for block in decontaminate.query_blocks(bench, window=4, most=most):
            assert sum(len(h) for _, h in block) <= most
            for i, h in block:
                n = min(4, len(h))
                got[i] |= {h[k : k + n].tobytes() for k in range(len(h) - n + 1)}
        assert got == want


def test_contamination_in_many_blocks(spark, docs, doc_rows, monkeypatch):
    words = alnum(doc_rows[7][1])
    bench = spark.createDataFrame([(1, " ".join(words[:40])), (2, " ".join(words[20:60]).upper()), (3, "hello there")], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contamination(docs, bench).drop("items").collect()), key=repr)
    monkeypatch.setattr(decontaminate.query_blocks, "__defaults__", (10, 12, "item_id", "text"))
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).drop("items").collect()), key=repr) == whole


def test_phrases_stay_small():
    """Two million benchmark words: a few dozen bytes a word."""
    h = np.random.default_rng(1).integers(0, 1 << 62, 1 << 17).astype(np.uint64)
    q = decontaminate.Phrases([("x", h)])
    assert sum(x.nbytes for x in vars(q).values() if isinstance(x, np.ndarray)) < 48 * len(h)


VOCABULARY = public_tokenizers.path(packing.VOCABULARY)


def test_encoder_is_exact(doc_rows):
    import pyarrow as pa

    assert tokens.unsafe_ids(VOCABULARY) == frozenset()
    texts = [r[1] for r in doc_rows] + ["it's we'll DON'T 12ab -- ¿qué? naïvé  x y <|startoftext|>z", "a\rb\x0bc", "İstanbul ΑΣ"]
    ids, cut = tokens.Encoder(VOCABULARY).encode(pa.array(texts, pa.string()))
    full = Tokenizer.from_file(VOCABULARY)
    for t, a, b in zip(texts, cut[:-1], cut[1:], strict=True):
        assert ids[a:b].tolist() == full.encode(t or "", add_special_tokens=False).ids
    # with every token held unsafe, all chunks take the other way and agree
    assert tokens.Encoder(VOCABULARY, frozenset(range(49408))).encode(pa.array(texts, pa.string()))[0].tolist() == ids.tolist()


def test_pieces_are_tokenised_once():
    """A word that stands before different signs, or in capitals, goes through the merger once; ids are those of the tokenizer."""
    import pyarrow as pa

    texts = ["Word. word, WORD!! (word) word's word 'word' ...", "ÀÉß; àéß: İx K ª. µ, x<|y <|endoftext|>. a1. 12, \t, word\u00a0, ''", None, ""]
    full, calls = Tokenizer.from_file(VOCABULARY), []
    for unsafe in (frozenset(), tokens.unsafe_ids(VOCABULARY), frozenset(range(0, 49408, 3))):
        enc = tokens.Encoder(VOCABULARY, unsafe)
        merge = enc.merge
        enc.merge = lambda piece, merge=merge: calls.append(piece) or merge(piece)
        for _ in range(2):
            ids, cut = enc.encode(pa.array(texts, pa.string()))
            assert [ids[i:j].tolist() for i, j in zip(cut, cut[1:])] == [full.encode(t or "", add_special_tokens=False).ids for t in texts]
    enc, calls = tokens.Encoder(VOCABULARY), []
    merge, enc.merge = enc.merge, lambda piece: calls.append(piece) or merge(piece)
    enc.encode(pa.array(["Word. word, WORD!! word"]))
    assert sorted(calls) == sorted(x + tokens.END for x in (b"word", b".", b",", b"!!"))


def test_packing(docs, doc_rows, no_docs):
    full = Tokenizer.from_file(VOCABULARY)
    size = 64
    out = [r for r in packing.pack(docs, sequence=size).collect()]
    ids = collections.Counter(tuple(full.encode(r[1] or "", add_special_tokens=False).ids) + (1,) for r in doc_rows)
    total = sum(len(k) * n for k, n in ids.items())
    assert sum(r.length for r in out) == total
    known = {(len(k), zlib.crc32(b"".join(struct.pack("<I", i) for i in k[a : a + n])), a) for k in ids for r in out if r.doc_tokens == len(k) for a, n in [(r.start, r.length)]}
    assert all((r.doc_tokens, r.ids_crc32, r.start) in known for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    lengths = {}
    for s, rows in by.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        lengths[s] = at
    assert sorted(by) == list(range(len(by)))
    assert all(n == size for s, n in lengths.items() if s < total // size) and all(n & (n - 1) == 0 for n in lengths.values())
    source = collections.Counter()
    for r in out:
        source[r.source] += r.length
    for s in range(total // size - 2):
        have = collections.Counter()
        for r in by[s]:
            have[r.source] += r.length
        assert all(abs(have[k] - size * v / total) <= len(source) for k, v in source.items())
    assert packing.pack(no_docs).count() == 0


def test_mixture_of_many_queues():
    sizes = [7, 1, 100_000, 3, 50_000, 0, 12_345] + [11] * 60
    m = packing.Mixture(sizes, 64)
    seen = {}
    for q, n in enumerate(sizes):
        if n:
            _, a, k, s, o = m.pieces(q, np.array([0]), np.array([n]))
            assert k.sum() == n and (np.diff(a) > 0).all()
            for x, y, z in zip(s.tolist(), o.tolist(), k.tolist(), strict=True):
                seen.setdefault(x, []).append((y, z))
    for x, spans in seen.items():
        at = 0
        for y, z in sorted(spans):
            assert y == at
            at += z
        assert at == 64 or (x >= m.full and at in m.tail)


@pytest.mark.parametrize("queues", [3, 50, 1000])
def test_mixture_holds_shares_in_every_window(queues):
    """What a queue is owed stays within a few tokens in a cycle's windows of one sequence, however many queues there are; from cycle to cycle only the rounding of its share adds up."""
    r = np.random.default_rng(queues)
    sizes = (r.integers(1, 1000, queues) * 20_000).tolist()
    m = packing.Mixture(sizes, 64)
    phase = m.phases[0]
    w = np.append(np.arange(1, phase.cycle), m.starts[1])
    owed = phase.given(slice(None), w) - w[:, None] * 64 * np.array(sizes) / m.total
    assert m.starts[1] > 0.9 * m.total / 64 and np.abs(owed[:-1]).max() < 2.5 and np.abs(owed[-1]).max() < 1e-4 * m.total
    assert (np.diff(phase.given(slice(None), np.arange(2000)), axis=0).sum(axis=1) == 64).all()


def test_mixture_with_targets():
    sizes = [6400, 6400, 6400, 640]
    m = packing.Mixture(sizes, 64, [1, 1, 2, 0])
    got = np.zeros((len(sizes), m.full + len(m.tail)), np.int64)
    for q, n in enumerate(sizes):
        _, _, k, s, _ = m.pieces(q, np.array([0]), np.array([n]))
        np.add.at(got[q], s, k)
    assert (got[:, :199] == [[16]] * 2 + [[32]] + [[0]]).all()
    # the third is dry, then the first two share, and the one without a weight comes last
    assert (np.abs(got[:2, 201:298] - 32) <= 1).all() and not got[3, :298].any()
    assert (got.sum(axis=1) == sizes).all()


def test_thin_queues_are_looked_up_by_token():
    m = packing.Mixture([4000, 64_000_000], 64)
    began = time.process_time()
    _, a, k, s, _ = m.pieces(0, np.array([0]), np.array([4000]))
    assert k.sum() == 4000 and s[-1] - s[0] > 900_000 and time.process_time() - began < 2


def test_packing_with_targets(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 3)
    docs = spark.createDataFrame([(i, "word " * 100, f"s{i % 6}") for i in range(120)], "doc_id long, text string, source string").repartition(3)
    out = packing.pack(docs, sequence=64, targets={"s4": 3.0, "s5": 1.0}).collect()
    have = collections.Counter()
    for r in out:
        if r.sequence_id < 30:
            have[r.source] += r.length
    assert have == {"s4": 30 * 48, "s5": 30 * 16} and sum(r.length for r in out) == 120 * 101


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://b.com/x", "<p>one"), (2, "http://a.b.com/y?q=1", "<p>two é"), (3, None, "<p>one"), (4, "http://[bad", None), (5, "http://b.com/x", ""), (5, "http://b.com/x", ""), (None, "http://c.com", "<p>one"), (7, "http://b.com/x\r\nEvil: 1", "<p>three")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    out = warc.round_trip(pages)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = collections.Counter()
    for i, _, h in rows:
        b, f = (h or "").encode(), first[h or ""]
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if f != i else "response", f if f != i else None)] += 1
    assert collections.Counter(tuple(r) for r in out.drop("url").collect()) == want
    folder = f"file://{tmp_path}/out"
    entries = warc.write_archives(pages, folder)
    forward = lambda df: sorted((r.asDict() for r in df.collect()), key=repr)
    assert forward(entries) == forward(warc.captures(spark, folder))
    index = warc.build_index(entries, f"file://{tmp_path}/index", block_lines=2)
    assert index.directory.count() >= 4
    found = warc.lookup(index, folder, "http://b.com/x")
    assert sorted(r["page_id"] for r in found) == [1, 5, 5]
    assert warc.lookup(index, folder, "http://nowhere.org/") == []
    some = spark.createDataFrame([("com,b)/x", warc.STAMP, 5), ("com,c)/", warc.STAMP, None), ("com,c)/", warc.STAMP, 9)], "key string, stamp string, page_id long")
    assert sorted((r.page_id or 0, r.url) for r in warc.read_back(folder, warc.resolve(index, some)).collect()) == [(0, "http://c.com"), (5, "http://b.com/x"), (5, "http://b.com/x")]
    assert gzip.open(sorted(tmp_path.glob("out/*.warc.gz"))[0]).read().startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_hot_key_over_many_blocks(spark):
    """Pages of one URL, with and without an id, fill many blocks; each comes back once."""
    rows = [(i % 7 if i % 3 else None, None, f"<p>{i % 50}") for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    out = warc.round_trip(pages)
    assert collections.Counter((r.page_id, r.payload_digest) for r in out.collect()) == collections.Counter((i, warc.digest(h.encode())) for i, _, h in rows)


def test_surt():
    assert warc.surt("HTTPS://Www.Example.com:443/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.surt("http://h.org:81") == "org,h:81)/" and warc.surt(None) == warc.surt("nothing") == "-"


MESSAGE = "conv_id long, position long, kind string, call_id string, name string, arguments string, content string, depends_on array<string>"


def messages(spark):
    rows = [
        (1, 0, "system", None, None, None, "hi", None), (1, 1, "call", "b", "add", '{"x": 2.0, "y": 1}', None, ["a"]), (1, 2, "call", "a", "add", '{"y": 1, "x": "no"}', None, None), (1, 3, "result", "b", None, None, "3", None),
        (1, 4, "result", "a", None, None, "2", None), (1, 5, "result", "zz", None, None, "lost", None), (2, 0, "call", "p", "add", "{broken", None, ["q"]), (2, 1, "result", "p", None, None, "", None),
        (2, 2, "call", "q", "gone", "{}", None, ["p"]), (2, 3, "result", "q", None, None, None, None), (None, 0, "call", "a", "add", '{"x": 1, "x": 2}', None, []), (3, None, None, None, None, None, None, None), (3, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, MESSAGE).withColumn("level", F.lit("clash"))


ADD = {"add": {"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": "integer"}}, "required": ["x", "y"], "additionalProperties": False}}


@pytest.mark.parametrize("local", [10_000, 0])
def test_tool_calls(spark, monkeypatch, local):
    monkeypatch.setattr(tool_calls, "LOCAL_MESSAGES", local)
    out = tool_calls.format_messages(messages(spark), ADD).collect()
    assert len(out) == 13
    one = {r.position: r for r in out if r.conv_id == 1}
    assert [one[p].ordinal for p in (0, 2, 5, 4, 1, 3)] == list(range(6))
    assert [one[p].level for p in (0, 2, 5, 4, 1, 3)] == [0, 0, 0, 1, 2, 3]
    assert (one[1].valid, one[2].valid, one[2].errors) == (True, False, ["$.x: type"])
    assert one[1].json == '{"arguments":{"x":2,"y":1},"call_id":"b","kind":"call","name":"add"}'
    assert one[3].linked and not one[5].linked and one[0].linked is None
    two = {r.position: r for r in out if r.conv_id == 2}
    assert {two[p].level for p in two} == {-1} and two[0].errors == ["unparsable"] and two[2].errors == ["unknown name"]
    assert json.loads(two[0].json)["arguments"] == "{broken"
    assert [r.errors for r in out if r.conv_id is None] == [["unparsable"]]
    assert tool_calls.format_messages(messages(spark).limit(0), ADD).count() == 0


def test_tool_calls_of_odd_arguments(spark):
    """Overflowing numbers, deep nesting, half surrogate pairs and doubled keys are unparsable, and crash nothing."""
    odd = ['{"x": 1e999}', "[" * 5000 + "]" * 5000, '{"x": "\\ud800"}', '{"x": 1, "x": 2}', "NaN", "9" * 5000, ""]
    rows = [(1, i, "call", f"c{i}", "add", a, None, None) for i, a in enumerate(odd)] + [(1, 99, "result", "c0", None, None, "x" * 300_000, None)]
    out = tool_calls.format_messages(spark.createDataFrame(rows, MESSAGE), ADD).collect()
    assert [r.errors for r in sorted(out, key=lambda r: r.position)] == [["unparsable"]] * len(odd) + [None]
    assert all(json.loads(r.json)["arguments"] == odd[r.position] for r in out if r.kind == "call")
    with pytest.raises(ValueError, match="pattern"):
        tool_calls.format_messages(spark.createDataFrame(rows, MESSAGE), {"add": {"properties": {"x": {"pattern": "("}}}})


def test_levels_of_long_chains_and_meshes(spark, monkeypatch):
    """Chains, ladders, repeated ids, cycles and what waits behind them: doubling gives the levels of the local pass."""
    r = np.random.default_rng(4)
    rows = [(1, i, "call", f"c{i}", "add", "{}", None, [f"c{i - 1}"]) for i in range(300)] + [(1, 1000 + i, "result", f"c{i}", None, None, "", None) for i in range(299)]
    for i in range(60):
        rows += [(2, i, "call", f"m{i}", "add", "{}", None, [f"m{k}" for k in r.integers(0, max(i, 1), 3).tolist()] * bool(i) + ["only"]), (2, 500 + i, "result", f"m{i}", None, None, "", None)]
    rows += [(2, 700, "result", "only", None, None, "", None), (2, 701, "call", "m5", "add", "{}", None, ["m3"]), (2, 702, "call", None, "add", "{}", None, ["m3"])]
    for a, b in (("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "v"), ("u", "c1"), ("t", "u")):
        rows += [(3, len(rows), "call", a, "add", "{}", None, [b, "u"] if a == "w" else [b]), (3, 2000 + len(rows), "result", a, None, None, "", None)]
    frame = spark.createDataFrame(rows, MESSAGE).coalesce(2).withColumn("message", F.monotonically_increasing_id()).persist()
    found = {}
    for local in (10_000, 50):
        monkeypatch.setattr(tool_calls, "LOCAL_MESSAGES", local)
        found[local] = sorted((x.conv_id, x.position, x.level, x.ordinal) for x in tool_calls.order(frame).collect())
    assert found[50] == found[10_000]
    level = {(c, p): k for c, p, k, _ in found[50]}
    assert [level[1, i] for i in range(300)] == [2 * i for i in range(300)] and level[2, 0] == 1 and level[2, 1] == 3 and level[2, 702] == 0
    assert sorted(o for c, _, _, o in found[50] if c == 1) == list(range(599))


def test_schema_rules():
    v = tool_calls.violations
    assert v([1, "a"], {"type": "array", "items": {"type": "integer"}, "maxItems": 1}) == ["$: items", "$[1]: type"]
    assert v("abc", {"type": ["string", "null"], "pattern": "^b", "maxLength": 2, "enum": ["x"]}) == ["$: enum", "$: length", "$: pattern"]
    assert v(True, {"type": "integer"}) == ["$: type"] and v(5, {"minimum": 6}) == ["$: bounds"] and v({"k": 1}, {"additionalProperties": {"type": "string"}}) == ["$.k: type"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div></div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"), ("<ol start=9><li>a<li>b<p>c</ol>", "9. a\n10. b\n\n    c"), ("<table><tr><td>x<td>long cell<tr><td>wider<td>y</table>", "x      long cell\nwider  y"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"), ("<p hidden>a</p><p style='display: none'>b</p><script>c</script><style>d</style>e<!-- f -->", "e"), ("<head><title>t</title></head><body>b", "b"),
        ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"), ("<details><summary>s</summary>h</details><details open><summary>t</summary>v</details>", "s\nt\nv"), ("&lt;b&gt; &amp;&nbsp;x", "<b> & x"), ("</p>a</div></b>b", "ab"),
        ("<a href='x>y'>t</a", "t"), ("<p title=it's>Hello", "Hello"), ('<div class="x"">Hello', "Hello"), ("<a title = 'x>y'>t", "t"), ("<", "<"), ("<b>x", "x"), ("<td>a<td>b", "ab"), ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\n\nin"),
    ],
)
def test_visible_text(html, text):
    assert visible_text(html) == text


def test_visible_words_of_generated_markup():
    """Every visible word once and in order, nothing of hidden elements, blocks on lines of their own, cells of a row on one."""
    r = np.random.default_rng(6)
    count = iter(range(1_000_000))

    def inline(depth, seen):
        out, kept = [], []
        for _ in range(int(r.integers(1, 4))):
            word = f"w{next(count)}"
            kind = r.integers(0, 5)
            if kind == 0 and depth:
                tag = r.choice(["b", "span", "a", "em"])
                hide = r.choice(["", "", " hidden", " style='display:none'"])
                inner, more = inline(depth - 1, seen and not hide)
                out.append(f"<{tag}{hide}>{inner}</{tag}>")
                kept += more
            elif kind == 1:
                out.append(f"<script>{word} < 1</script>" if r.random() < 0.5 else f"<!-- {word} -->")
            else:
                out.append(f" {word} ")
                kept += [word] if seen else []
        return "".join(out), kept

    def block(depth, seen):
        out, kept, lines = [], [], []
        for _ in range(int(r.integers(1, 4))):
            kind = r.integers(0, 4) if depth else 3
            hide = r.choice(["", "", "", " hidden"])
            if kind == 0:
                inner, more, rows = block(depth - 1, seen and not hide)
                out.append(f"<div{hide}>{inner}</div>")
                kept, lines = kept + more, lines + rows
            elif kind == 1:
                items = [inline(1, seen and not hide) for _ in range(int(r.integers(1, 4)))]
                out.append(f"<ul{hide}>" + "".join(f"<li>{x}" for x, _ in items) + "</ul>")
                kept, lines = kept + [w for _, k in items for w in k], lines + [k for _, k in items if k]
            elif kind == 2:
                cells = [[inline(1, seen and not hide) for _ in range(2)] for _ in range(2)]
                out.append(f"<table{hide}>" + "".join("<tr>" + "".join(f"<td>{x}" for x, _ in row) for row in cells) + "</table>")
                rows = [[w for _, k in row for w in k] for row in cells]
                kept, lines = kept + sum(rows, []), lines + [x for x in rows if x]
            else:
                inner, more = inline(2, seen and not hide)
                out.append(f"<p{hide}>{inner}")
                kept, lines = kept + more, lines + ([more] if more else [])
        return "".join(out), kept, lines

    for _ in range(400):
        source, kept, lines = block(3, True)
        text = visible_text(source)
        assert re.findall(r"w\d+", text) == kept
        assert [re.findall(r"w\d+", x) for x in text.split("\n") if "w" in x] == lines


def test_visible_text_of_deep_markup():
    assert visible_text("<div>" * 20_000 + "x") == "x"
    assert visible_text("<ul><li>" * 300 + "x").endswith("- x")


@pytest.mark.parametrize("page", ["<b>{n}</i>{n}", "<i><table><td><b>{n}</i>{n}", "<b>{n}<div>{n}", "a</x>{n}", "<ul><li>x{n}", "<p a='{n}", "<option>{n}"])
def test_visible_text_takes_linear_time(page):
    """Ten times the markup takes about ten times as long."""

    def seconds(n):
        source = "".join(x * n for x in page.split("{n}")[:-1]) + page.split("{n}")[-1]
        began = time.process_time()
        visible_text(source)
        return time.process_time() - began

    assert seconds(40_000) < 30 * max(seconds(4_000), 0.02)


def test_extract(spark):
    rows = [(1, "<p>a<p>b", "clash"), (2, None, "x"), (2, None, "x"), (None, "<ul><li>c", None), (3, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract(pages)
    assert got.columns == pages.columns
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter((i, h, visible_text(h)) for i, h, _ in rows)
    assert html_text.extract(pages.limit(0)).count() == 0


