"""The pipeline's stages against brute force, each on its own input."""

import collections

import corpus_pipeline
from tests.llm.conftest import make_texts
from tests.llm.test_dedup import components, deleted_lines
from tests.llm.test_text import alnum


def test_stages(spark, tmp_path):
    texts = [t for t in make_texts() if t is not None and len(t) < 20_000]
    clean = [f"{t}\nrow {i}" if i % 3 else t for i, t in enumerate(texts * 2)]
    toxic = [f"you are a worthless idiot and a clown number {i} " * (1 + i % 3) for i in range(60)]
    calm = [f"the weather of day {i} is fine and calm for a walk " * (1 + i % 3) for i in range(120)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean + toxic + calm)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    n = len(clean)
    labels = [(i, 1, int(i < n + 60)) for i in range(n, len(rows))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = " ".join(alnum(clean[7])[2:16])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.scratch.keep(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS

    ids = {name: {r.doc_id for r in found} for name, found in kept.items()}
    assert not ids["toxicity"] & set(range(n, n + 60)) and ids["toxicity"] >= set(range(n + 60, len(rows)))

    before = [(r.doc_id, r.text) for r in kept["toxicity"]]
    gone = deleted_lines(before, 20)
    after = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) for (i, t), g in gone.items()}
    emptied = {i for (i, t), g in gone.items() if g and not after[i].strip()}
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == {i: t for i, t in after.items() if i not in emptied}
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])

    root = components([(r.doc_id, r.text) for r in kept["line_dedup"]])[1]
    assert ids["near_copies"] == {i for i, r in root.items() if i == r}

    words = alnum(leak)
    windows = {tuple(words[k : k + 10]) for k in range(len(words) - 9)}
    holds = lambda t: any(tuple(w[k : k + 10]) in windows for w in [alnum(t)] for k in range(len(w) - 9))
    assert ids["decontamination"] == {r.doc_id for r in kept["near_copies"] if not holds(r.text)} != ids["near_copies"]

    tokens = collections.Counter()
    for r in kept["packing"]:
        tokens[r.doc_id] += r.length
    assert set(tokens) == ids["decontamination"] and all(tokens[r.doc_id] == r.doc_tokens for r in kept["packing"])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run_stages(spark, folder, rows, bench):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.scratch.keep(stage(spark, docs, str(folder)), name)
        kept[name] = docs.collect()
    return kept


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated ids and rows, and no labels: nothing is lost but copies, repeats and leaks."""
    line = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    same = line(1, 60)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", None, "b", 7), (None, line(2, 30), "en", None, 1), (4, line(3, 30), "en", "a", 1), (4, line(4, 30), "en", "a", 1), (4, line(4, 30), "en", "a", 1),
        (5, same, "en", "a", 1), (6, same + " more", "en", "a", 1), (7, line(5, 20_000), "en", "c", 1), (None, None, None, None, None), (8, "leak " + line(6, 12), "en", "a", 1), (9, line(7, 25) + "\n" + line(8, 25), "en", "a", 1), (10, line(7, 25) + "\nother", "en", "a", 1),
    ]
    kept = run_stages(spark, tmp_path, rows, [(1, line(6, 12)), (None, same), (2, None)])
    assert collections.Counter(map(tuple, kept["toxicity"])) == collections.Counter(rows)
    assert {r.doc_id: r.text for r in kept["line_dedup"]}[10] == "other" and len(kept["line_dedup"]) == len(rows)
    ids = lambda name: collections.Counter(r.doc_id for r in kept[name])
    assert ids("near_copies") == ids("line_dedup") - collections.Counter({6: 1})
    assert ids("decontamination") == ids("near_copies") - collections.Counter({8: 1})
    ends = collections.Counter(r.doc_id for r in kept["packing"] if r.start + r.length == r.doc_tokens)
    assert ends == ids("decontamination")


def test_no_documents(spark, tmp_path):
    assert not any(run_stages(spark, tmp_path, [], []).values())
