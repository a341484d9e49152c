"""The pipeline's stages on the smallest tables, each held against what its operator says of its own input."""

import random
import re

import corpus_pipeline
import duckdb
import pandas as pd
from tessera.llm import decontaminate, mixing, pii, quality

SF = "/root/testdata/sf0.001"


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, __row_key string"


def sql(query: str, **tables) -> pd.DataFrame:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.execute(query).df()


def test_stages_keep_clean_documents_and_apply_decisions(spark):
    """Each stage on its own input, against SQL or brute force over the whole of the smallest tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = pd.read_parquet(f"{SF}/benchmark.parquet")
    names, tables, before = [n for n, _ in corpus_pipeline.STAGES], [docs], []
    assert len(names) == 5
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before.append(tables[-1].toPandas())
        out = stage(spark, tables[-1], SF)
        if i < 4:
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.toPandas(), docs.schema)
        tables.append(out)
    after = [t.toPandas() for t in tables[1:]]
    ids = [set(t.doc_id) for t in after]

    judged = sql(quality.OP2_SQL, documents=before[0]).set_index("doc_id")
    assert ids[0] == set(judged[judged.kept].index)
    lost = {r.doc_id: len(r.text.split()) for r in before[0].itertuples()}
    assert all(lost[r.doc_id] - len(r.text.split()) == judged.words_removed[r.doc_id] and r.n_chars == len(r.text) for r in after[0].itertuples())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(k in ids[0] for k, r in labels.items() if r.quality == 1 and lost[k] >= 50)

    assert ids[1] == least_of_groups(list(before[1].itertuples()))
    leaks = sql(decontaminate.OP6_SQL, documents=before[2], benchmark=benchmark)
    assert ids[2] == set(before[2].doc_id) - set(leaks.doc_id)

    redacted = {r.doc_id: r.text for r in after[3].itertuples()}
    assert ids[3] == ids[2] and all(not pii.base_spans(t) for t in redacted.values())
    for r in before[3].itertuples():
        left = re.split("|".join(f"<{k}>" for k in pii.KINDS), redacted[r.doc_id])
        assert re.fullmatch(".*".join(re.escape(x) for x in left), r.text, re.S)  # nothing but spans is replaced

    want = sql(mixing.OP8_SQL, documents=before[4]).set_index("doc_id")
    mixed = after[4]
    assert mixed.groupby("doc_id").words.sum().to_dict() == want.taken[want.taken > 0].to_dict()
    for r in mixed.itertuples():
        shards = want.shards[r.doc_id].split(",")
        whole = redacted[r.doc_id]
        assert str(r.shard) in shards and len(r.text.split()) == r.words and (r.text == whole or whole.split()[: r.words] == r.text.split())
    assert all(list(g.place) == sorted(g.place) for _, g in mixed.groupby("shard", sort=False)) and list(mixed.shard) == sorted(mixed.shard)


def least_of_groups(docs: list) -> set:
    """Ids that stay: of texts linked at 0.8 of five-word shingles the least."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), d.text).split() for d in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in words]
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return {min(docs[i].doc_id for i in range(len(docs)) if root[i] == r) for r in set(root)}


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "taken", "target", "shard", "place", "text"} <= set(got.columns) and got.count() > 0


def test_rows_that_repeat_ids_or_have_none(spark):
    """Rows are told apart by id and text: unlike ones stay, copies go once, and other columns stay as they are."""
    rng = random.Random(6)
    text = lambda n=80: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "."
    a, b, c, d, e, f = (text() for _ in range(6))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first().text
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (None, e), (None, f), (None, f), (None, f"{text(30)} {item} {text(30)}"), (9, text(300_000)), (None, None), (10, ""), (11, " \n ")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "mine", "mine") for i, t in rows], SCHEMA)
    docs = docs.drop("__row_key")
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns and {r.extra for r in near.collect()} == {"mine"}
    assert sorted(t for t in near.toPandas().text if t and len(t) > 5) == sorted([a, b, c, d, e, f, rows[9][1], rows[10][1]])
    assert near.where("doc_id = 1").count() == 1 and near.where("doc_id = 2").count() == 1
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    assert clean.count() == docs.count() - 1 and clean.where("doc_id is null").count() == 4
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.personal_data(spark, corpus_pipeline.quality_rules(spark, docs, SF), SF).columns == docs.columns


def test_near_duplicates_are_those_of_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        edited, longer = list(base), base + [f"v{rng.randrange(5000)}" for _ in range(len(base) // 6)]
        for at in rng.sample(range(len(base)), 2):
            edited[at] = "edit"
        texts += [base, edited, longer, base[: len(base) // 2]]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    want = {i for i, r in enumerate(root) if i == r}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == want
    assert len(want) < 36
