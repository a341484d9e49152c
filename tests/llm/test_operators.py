"""Each operator against brute force or SQL on small tables with nulls, empty and long texts, repeats and clashing names."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import blocks, decontaminate, fixity, jaccard, licenses, mixing, packed, pii, quality, quotes, shared, substrings, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def sql(query: str, **tables) -> pd.DataFrame:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.execute(query).df()


def rows(df) -> list:
    df = df.toPandas() if hasattr(df, "toPandas") else df
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and not isinstance(v, (str, bytes)) and type(v).__name__ != "bool" else bool(v) if type(v).__name__ == "bool" else v
    return sorted(repr([clean(v) for v in r]) for r in df.itertuples(index=False))


def corpus() -> list:
    """Texts of few words with copies, near copies, short ones, nulls, long ones, and marks of every kind."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \t\n ", "one", "One two", "a b c", "x " * 3000, "a" * 5000, "\n".join(["THE!! END!! NOW!!"] * 30), "menu | home | about | help\n" * 20]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = word()
            texts.append(rng.choice([" ", "\n", "  "]).join(other).upper() if rng.random() < 0.2 else " ".join(other))
    texts += ["This work is licensed under the GNU General Public License, version 3.", "gnu general\npublic license cc-by apache license", "mit license MIT License mit licence"]
    return [(i, t, "en", rng.choice(["a", "b", None, "é"]), len(t or ""), "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def pandas_docs() -> pd.DataFrame:
    return pd.DataFrame(corpus(), columns=["doc_id", "text", "lang", "source", "n_chars", "kept"])


def test_quality_matches_sql(docs):
    got = quality.clean_lines(docs, texts=False).select("doc_id", *quality.COUNTS, "base_failed", "kept", "n_lines_removed", "words_removed")
    assert rows(got) == rows(sql(quality.OP2_SQL, documents=pandas_docs()))


def test_quality_removes_lines_and_keeps_the_rest(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    text = f"{good}\nhome | about | help | more\nAccept all cookies\nlast line here."
    row = quality.clean_lines(spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0] == row[1] and row[0].clean_text == f"{good}\nlast line here." and row[0].kept and row[0].n_lines_removed == 2
    assert row[2].clean_text is None and not row[2].kept


def test_quality_line_rules(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    bad = ["All rights reserved" + "." * 41, "Home > About us > Contact", "Home » News » Sport » Weather", "© 2024 Example Ltd. All rights reserved worldwide", "-- ** --", "Sign in!", "A line of many words that just stops without"]
    fine = ["A short heading", "> a quoted line has one mark.", "Is it so?", 'He said "yes."', "This line of seven words is wrapped", "and goes on with a small letter here.", "He signed in again and read more of the privacy policy of the firm that he had left long ago."]
    texts = [good] + [f"{good}\n{x}" for x in (*bad, *fine)]
    whole = good + "\n" + "\n".join(fine)
    df = spark.createDataFrame(list(enumerate([*texts, whole])), "doc_id long, text string")
    got = [r.n_lines_removed for r in quality.clean_lines(df).orderBy("doc_id").collect()]
    assert got == [0] + [1] * len(bad) + [0, 0, 0, 0, 1, 0, 0] + [0]
    table = pd.DataFrame(list(enumerate([*texts, whole])), columns=["doc_id", "text"])
    assert rows(quality.op2_columns(quality.clean_lines(df, texts=False))) == rows(sql(quality.OP2_SQL, documents=table))


def test_jaccard_matches_sql(spark, docs):
    got = jaccard.jaccard_join(docs, k=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")
    assert rows(got) == rows(sql(jaccard.OP5_SQL, documents=pandas_docs()))


def brute_links(texts: list[str], percent: int) -> tuple[list[int], list[int]]:
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    up, count = list(range(len(texts))), [0] * len(texts)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                count[i] += 1
                count[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))], count


@pytest.mark.parametrize(("percent", "posting"), [(90, 1000), (70, 1000), (90, 7), (70, 7)])
def test_jaccard_chains_and_split_postings(spark, monkeypatch, percent, posting):
    """A large group of near copies whose pairs are on both sides of the threshold; small postings and blocks give the same."""
    monkeypatch.setattr(jaccard, "POSTINGS", posting)
    monkeypatch.setattr(jaccard, "MOST", posting)
    monkeypatch.setattr(jaccard, "SMALL", min(posting - 1, jaccard.SMALL))
    monkeypatch.setattr(jaccard.blocks, "BLOCK", 16 if posting < 100 else 256)
    monkeypatch.setattr(jaccard.blocks, "BLOCK_TOKENS", 1000 if posting < 100 else 1 << 19)
    rng = random.Random(percent)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for _ in range(70):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"u{rng.randrange(60)}" for _ in range(rng.randint(3, 60))) for _ in range(40)] + texts[:5]
    got = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=3, percent=percent).orderBy("doc_id").collect()
    component, count = brute_links(texts, percent)
    assert [r.component_id for r in got] == component and [r.n_links for r in got] == count


@pytest.mark.parametrize("percent", [30, 50, 60, 80, 90])
def test_jaccard_short_texts_at_any_threshold(spark, percent):
    rng = random.Random(percent)
    texts = ["a b c", "a b c d"] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(90)]
    got = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=3, percent=percent).orderBy("doc_id").collect()
    component, count = brute_links(texts, percent)
    assert [r.component_id for r in got] == component and [r.n_links for r in got] == count


def test_jaccard_sets_are_few_files(spark, monkeypatch):
    """Each file of a table starts processes beside the executor: many small splits don't make many files."""
    written, plain = {}, jaccard.materialize

    def noted(df, name, *args, **kwargs):
        out = plain(df, name, *args, **kwargs)
        written[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(jaccard, "materialize", noted)
    df = spark.createDataFrame([(i, f"a b c d{i // 2} e f") for i in range(40)], "doc_id long, text string").repartition(20)
    assert jaccard.jaccard_join(df, k=3, percent=90).where("component_id <> doc_id and n_links = 1").count() == 20
    assert written["jaccard-sets"] <= 8


def test_jaccard_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, jaccard.jaccard_join(df).collect()))
    assert sum("component_id=7" in x for x in got) == 3 and sum("n_links=2" in x for x in got) == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard.jaccard_join(none).count() == 0
    assert substrings.repeated_passages(none).count() == 0
    assert quality.clean_lines(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert pii.find_pii(none, redact=True).count() == 0
    assert mixing.mix_digest(none).count() == 0
    assert decontaminate.contaminated(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string"), urlfilter.rule_table(spark)).count() == 0
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert fixity.fixity_audit(fixity.warc_records(pages), fixity.warc_records(pages)).count() == 0


def test_substrings_finds_moved_and_near_passages(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(90)
    near = list(passage)
    near[40] = "changed"
    texts = {
        1: fresh(50) + passage + fresh(20), 2: fresh(13) + passage + fresh(33), 3: fresh(7) + near + fresh(9), 4: fresh(200), 5: None, 6: [], 7: fresh(4),
        8: fresh(60) + ["\nthe", "same", "short", "line\n"] + fresh(50), 9: fresh(70) + ["\nthe", "same", "short", "line\n"] + fresh(40),
    }
    df = spark.createDataFrame([(k, None if v is None else " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    found = substrings.repeated_passages(df).collect()
    assert {r.doc_id for r in found} == {1, 2, 3}
    assert {r.doc_id for r in found if r.removed} == {2, 3} and {r.doc_id for r in found if not r.removed} == {1}
    one = next(r for r in found if r.doc_id == 1)
    assert one.first_word >= 50 and one.first_word + one.n_words <= 140 and one.n_words >= 50
    left = {r.doc_id: r.text for r in substrings.remove_passages(df, substrings.repeated_passages(df)).collect()}
    assert left[4] == " ".join(texts[4]) and left[5] is None and left[6] == "" and len(left[2].split()) < 100 and left[1] == " ".join(texts[1])


def test_substrings_paragraphs_are_content_defined(spark):
    import pyarrow as pa

    from tessera.llm.arrowtext import words

    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    cut = lambda text: [(x, y) for p in words(pa.array([text]), lower=True) for x, y in zip(*substrings.paragraphs(p, 1), strict=True)]
    a, b = cut(" ".join(w)), cut(" ".join(["zz"] * 31 + w[20:980]))
    inner = [(x, y) for x, y in a if x >= 80 and y <= 920]
    assert inner and all((x + 11, y + 11) in b for x, y in inner)


def removed_words(spark, texts: list) -> list:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = [set() for _ in texts]
    for r in substrings.repeated_passages(df).where("removed").collect():
        gone[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    return gone


def test_substrings_whole_lines_that_are_edited(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    lines = [fresh(60) for _ in range(8)]
    near = [x[:22] + ["edit"] + x[23:] for x in lines]
    gone = removed_words(spark, [" ".join(x) for x in lines] + [" ".join(fresh(9)) + "\n" + " ".join(x) + "\n" + " ".join(fresh(9)) for x in near])
    assert not any(gone[:8]) and all(g == set(range(9, 69)) for g in gone[8:])


def test_substrings_passages_inside_lines(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(51) for _ in range(40)]
    gone = removed_words(spark, [" ".join(fresh(30) + p + fresh(30)) for p in passages] + [" ".join(fresh(17) + p + fresh(40)) for p in passages] + [" ".join(fresh(8)[:1] * 100)])
    assert not any(gone[:40]) and gone[80] >= set(range(60, 100))
    assert all(g >= set(range(17, 68)) and len(g) < 64 for g in gone[40:80])  # more words where a piece links as a near copy


def test_substrings_passages_of_short_lines(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(80)
    wrapped = lambda n: "\n".join(" ".join(passage[i : i + n]) for i in range(0, 80, n))
    texts = [" ".join(fresh(20)) + "\n" + wrapped(n) + "\n" + " ".join(fresh(20)) for n in (4, 4, 3, 9)]
    gone = removed_words(spark, texts)
    assert not gone[0] and all(g == set(range(20, 100)) for g in gone[1:])


def test_substrings_every_repeat_of_40_words(spark):
    """Against all word runs: what repeats exactly in 40 words or more is found, shorter repeats mostly, and unrelated texts are left alone."""
    rng = random.Random(21)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(n) for n in (40, 41, 45, 50, 60, 80)]
    texts = []
    for _ in range(150):
        t = fresh(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            t = t + rng.choice(shared) + fresh(rng.randint(1, 40))
        texts.append(t)
    texts += [fresh(120) for _ in range(40)]
    short = [(n, fresh(n)) for n in range(16, 40) for _ in range(6)]
    at = len(texts)
    texts += [fresh(25) + p + fresh(30) for _, p in short] + [fresh(31) + p + fresh(20) for _, p in short]
    seen, again = {}, [set() for _ in texts]
    for d, t in enumerate(texts):
        for i in range(len(t) - 39):
            first = seen.setdefault(tuple(t[i : i + 40]), d)
            if first != d:
                again[d] |= set(range(i, i + 40))
    joined = ["".join(w + rng.choice([" ", " ", " ", "\n"]) for w in t) for t in texts[:at]] + [" ".join(t) for t in texts[at:]]
    gone = removed_words(spark, joined)
    assert all(g >= a for g, a in zip(gone, again, strict=True)) and sum(map(len, again)) > 2000
    assert not any(gone[150:190]) and sum(map(len, gone[:190])) <= 1.05 * sum(map(len, again))
    caught = {n: [] for n in (16, 24, 32)}
    for (n, _), g in zip(short, gone[at + len(short) :], strict=True):
        caught[n // 8 * 8].append(len(g & set(range(31, 31 + n))) >= 0.8 * n)
    share = {n: sum(x) / len(x) for n, x in caught.items()}
    print("share of repeats found by words", share)
    assert share[16] >= 0.3 and share[24] >= 0.6 and share[32] >= 0.8


def test_substrings_near_paragraphs_of_all_pairs(spark):
    """Of all pairs of lines with a similarity of 0.8 or more, nearly all later ones are removed."""
    rng = random.Random(22)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    lines = []
    for _ in range(60):
        base = fresh(rng.randint(20, 120))
        lines.append(base)
        for _ in range(2):
            other = list(base)
            for _ in range(rng.randint(1, 4)):
                other[rng.randrange(len(other))] = fresh(1)[0]
            lines.append(other)
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in lines]
    want = {b for b in range(len(lines)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    gone = removed_words(spark, [" ".join(x) for x in lines])
    whole = {i for i, g in enumerate(gone) if len(g) == len(lines[i])}
    assert len(want) > 30 and len(whole & want) >= 0.95 * len(want)


def test_substrings_values_are_dealt_packed(spark, monkeypatch):
    """Bands and places cost Spark a row for many values, and very common ones a row a task; what is found is the same."""
    rng = random.Random(24)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    common, line, base = fresh(60), fresh(12), fresh(50)
    texts = []
    for i in range(60):
        near = list(base)
        near[rng.randrange(50)] = f"edit{i}"
        texts.append("\n".join(" ".join(x) for x in (fresh(30) + common + fresh(9), line, near, line, fresh(40))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    some, _ = substrings.identified(df, "doc_id", "text")
    dealt = substrings.unit_places(substrings.unit_rows(some, 5, 80)).collect()
    values = sum(len(r.packed) // 24 for r in dealt)
    assert values > 300 and len(dealt) <= 5 * packed.buckets_of(spark)
    found = lambda: sorted(tuple(r) for r in substrings.repeated_passages(df).collect())
    plain = found()
    assert len({r[0] for r in plain if r[5]}) == 59
    monkeypatch.setattr(substrings, "HOT", 2)
    hot = substrings.unit_places(substrings.unit_rows(some, 5, 80)).groupBy("kind").count().collect()
    assert {r.kind for r in hot} == {substrings.PLACE, substrings.HOT_KEY, substrings.HOT_PLACE}
    assert found() == plain
    monkeypatch.setattr(substrings, "HELD", 50)
    assert found() == plain


def test_substrings_finds_are_dealt_to_few_buckets(spark):
    """A task of what is found again packs a row at most for each shuffle partition, and one each of what is told apart later."""
    rng = random.Random(26)
    texts = [" ".join(f"f{rng.randrange(10**9)}" for _ in range(200)) for _ in range(40)] * 2
    some, _ = substrings.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    places = substrings.unit_places(substrings.unit_rows(some, 5, 80)).unionAll(substrings.exact_spans(some))
    found = substrings.repeats(places, spark.createDataFrame([], "key long, class long")).select("bucket", F.length("packed").alias("n")).collect()
    parts = packed.buckets_of(spark, 1)
    assert sum(r.n for r in found) // 24 > 500 and {r.bucket for r in found} == set(range(parts)) and len(found) <= parts * packed.buckets_of(spark)


def test_links_of_small_groups_are_found_together(monkeypatch):
    """Groups of few sets are compared all at once, with the links that each of them has alone and no matrix of its own."""
    rng, members = random.Random(27), []
    for root in range(400):
        base = [rng.getrandbits(62) for _ in range(rng.randint(1, 60))]
        halves = root % 3 == 0
        for at in range(rng.randint(1, 9)):
            tokens = base[rng.randint(0, 3) :] + [rng.getrandbits(62) for _ in range(rng.randint(0, 6))]
            members.append((root, 0, int(halves), at % 2 if halves else 0, 10 * root + at, rng.randint(1, 3), len(tokens), np.array(tokens, np.int64).tobytes()))
    names = ["root", "i", "j", "side", "key", "copies", "n", "tokens"]
    table = pa.table({c: list(x) for c, x in zip(names, zip(*members, strict=True), strict=True)})
    found = lambda: sorted(tuple(r.values()) for b in blocks._links(table, 80, False, True) for r in b.to_pylist())
    monkeypatch.setattr(blocks, "SMALL", 1, raising=False)
    alone = found()
    matrices, plain = [], blocks.overlaps
    monkeypatch.setattr(blocks, "overlaps", lambda sets: matrices.append(len(sets)) or plain(sets))
    monkeypatch.setattr(blocks, "SMALL", 6, raising=False)
    monkeypatch.setattr(blocks, "SMALL_TOKENS", 500, raising=False)
    assert found() == alone and len(alone) > 500
    sets = {m[4]: (m, set(np.frombuffer(m[7], np.int64).tolist())) for m in members}
    want = {}
    for k, (m, s) in sets.items():
        near = [o for o, t in (sets[q] for q in range(10 * m[0], 10 * m[0] + 9) if q in sets) if o[4] != k and (not m[2] or o[3] != m[3]) and 100 * len(s & t) >= 80 * len(s | t)]
        if near:
            want[k] = sum(o[5] for o in near)
    assert {k: links for k, _, links in alone} == want
    assert len(matrices) < 150


def test_substrings_batches_to_python_are_bounded(spark, monkeypatch, tmp_path):
    """A task's texts and packed values go to Python in batches of bounded bytes, not all at once; the session keeps its own setting."""
    rng = random.Random(25)
    texts = [" ".join(f"f{rng.randrange(10**9)}" for _ in range(2000)) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (60, texts[7])], "doc_id long, text string").repartition(1)
    sizes, plain = str(tmp_path / "sizes"), substrings.map_arrow

    def noted(rows, run, schema):
        def seen(batches):
            for batch in batches:
                with open(sizes, "a") as f:
                    f.write(f"{batch.nbytes}\n")
                yield batch

        return plain(rows, lambda batches: run(seen(batches)), schema)

    monkeypatch.setattr(substrings, "map_arrow", noted)
    monkeypatch.setattr(shared, "BATCH_BYTES", 200_000, raising=False)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    assert [(r.doc_id, r.n_words, r.removed) for r in substrings.repeated_passages(df).orderBy("doc_id").collect()] == [(7, 2000, False), (60, 2000, True)]
    seen = [int(x) for x in open(sizes)]
    assert sum(seen) > 1_500_000 and max(seen) < 300_000
    assert spark.conf.get(key) == before


def test_substrings_odd_rows(spark):
    rng = random.Random(23)
    fresh = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    passage, other, long = fresh(45), fresh(45), fresh(30000)
    rows_ = [(None, passage + " " + fresh(9)), (None, fresh(5) + " " + passage), (None, None), (3, ""), (7, other), (7, other), (7, fresh(20) + " " + other), (8, long), (9, long), (10, fresh(50))]
    df = spark.createDataFrame([(i, t, "mine", "mine", 5) for i, t in rows_], "doc_id long, text string, key string, __gone string, row long")
    found = substrings.repeated_passages(df)
    got = found.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.removed) for r in got) == [(-1, False), (-1, True), (7, False), (7, True), (8, False), (9, True)]
    assert all(45 <= r.n_words <= 49 or r.n_words == 30000 for r in got)
    left = substrings.remove_passages(df, found)
    assert left.columns == df.columns and left.where("key = 'mine' and __gone = 'mine' and row = 5").count() == len(rows_)
    kept = sorted(len((r.text or "").split()) for r in left.collect())
    assert kept[-1] == 30000 and kept.count(0) in (3, 5) and 50 in kept and sum(kept) < 30000 + 54 + 50 + 3 * 45 + 20 + 50


def brute_base(t: str) -> list:
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits))) or (k == 3 and not 8 <= len(digits) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_pii_base_spans_are_the_patterns():
    rng = random.Random(5)
    for letters in ("a1@.- +(", "12.5", "1 -0", "+1 ()-.9", "ab@.%+-c", "0123456789 -.+@aé"):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == brute_base(t), t
    assert pii.base_spans("9" * 100_000 + "a" * 100_000 + "@") == []


def test_pii_query_and_held_out_accuracy(spark):
    rng = random.Random(2)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    secret = [(i, f'ab cd token = "{hexes()}" ef') for i in range(60)]
    plain = [(100 + i, f"see page {rng.randrange(200)} of version {rng.randrange(9)}.0 in {1900 + rng.randrange(100)}") for i in range(60)]
    base = [(200 + i, f"mail me.{i}@x{i}.example.com at 10.0.{i}.7 or +1 (017) 555-77{i:02d}") for i in range(40)]
    more = [(300, None), (301, ""), (302, "é " * 3000 + "a@b.cd"), (302, "é " * 3000 + "a@b.cd")]
    every = secret + plain + base + more
    train = spark.createDataFrame([r for r in every if r[0] % 2], "doc_id long, text string")
    model = pii.train(train)
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(every, "doc_id long, text string"), model=model, redact=True).collect()}
    for k, t in every:
        own = brute_base(t or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[x]}:{a}:{b}" for x, a, b in own).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.BASE_KINDS] == [sum(y[0] == i for y in own) for i in range(4)]
    held = [got[k] for k, _ in secret + plain if k % 2 == 0]
    right = sum(("secret:" in r.spans) == (r.doc_id < 100) and "number:" not in r.spans for r in held)
    assert right / len(held) >= 0.95
    assert got[0].redacted == 'ab cd token = "<secret>" ef' and got[300].redacted is None and got[301].redacted == ""


def planted_pii(rng: random.Random) -> dict:
    """Kind of planted case -> (text, start, end) makers, none of which a base rule finds."""
    pick = rng.choice
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    code = lambda n, of=alphabet: "".join(pick(of) for _ in range(n))
    digits = lambda n: code(n, "0123456789")
    words = lambda: " ".join(code(rng.randint(2, 9), "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 12)))
    cases = {
        "hex token": lambda: pick(['token = "{}"', "the key is {}", "{}"]).format(code(40, "0123456789abcdef")),
        "service key": lambda: pick(["export {}", "use {} here"]).format(pick(["ghp_", "sk_live_", "AKIA"]) + code(30)),
        "password": lambda: pick(["password is {}", "password: {}", "passwd={}"]).format(code(rng.randint(8, 14), "abcdefghijklmnopqrstuvwxyz")),
        "iban": lambda: pick(["iban {}", "pay to {}"]).format(f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"),
        "ssn": lambda: pick(["ssn {}", "number {}"]).format(f"{digits(3)}-{digits(2)}-{digits(4)}"),
        "national phone": lambda: pick(["call {}", "phone {}", "at {}"]).format(f"({digits(3)}) {digits(3)}-{digits(4)}"),
        "name": lambda: pick(["wrote {}", "by {}", "with {}"]).format(f"{pick(pii.GIVEN_NAMES)} {pick(pii.SURNAMES)}"),
        "titled name": lambda: f"saw {pick(['Dr', 'Mrs', 'Mr'])}. {pick(pii.SURNAMES)}",
        "address": lambda: pick(["lives at {}", "ship to {}"]).format(pick([f"{rng.randint(1, 999)} {pick(['Oak', 'Main', 'Mill'])} {pick(['Street', 'Road', 'Lane'])}", f"Lindenstraße {rng.randint(1, 99)}"])),
        "clean": lambda: pick(["see page {} of volume {}", "in {} about {} were sold", "version {}.{} is out", "chapter {}, figure {}"]).format(1900 + rng.randrange(120), rng.randrange(90)),
        "clean words": lambda: pick(["Anna went home", "the password was changed", "a secret of the trade", "In Paris. James", "Street level 5 of 9"]),
    }
    return {k: (lambda f=f: f"{words()} {f()} {words()}") for k, f in cases.items()}


def test_pii_recall_of_each_planted_kind(spark):
    """Trained on half of the rows without labels; recall by kind on the other half, and clean texts left alone."""
    makers = planted_pii(random.Random(31))
    data = [(i, make(), kind) for i, (kind, make) in enumerate((k, m) for _ in range(80) for k, m in makers.items())]
    train = spark.createDataFrame([r for r in data if (r[0] // len(makers)) % 2], "doc_id long, text string, kind string")
    rest = spark.createDataFrame([r for r in data if not (r[0] // len(makers)) % 2], "doc_id long, text string, kind string")
    found = pii.find_pii(rest, model=pii.train(train)).toPandas()
    share = found.assign(hit=found.n_spans > 0).groupby("kind").hit.mean().to_dict()
    assert all(share[k] >= 0.9 for k in makers if "clean" not in k), share
    assert share["clean"] <= 0.05 and share["clean words"] <= 0.25, share


def test_pii_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1 " * 50_000, "A" * 200_000 + "1", "Anna " * 30_000, "password " * 20_000, "9" * 200_000 + "x", "Rue " * 20_000):
        list(pii.candidates(t))


def test_licenses_match_sql(docs):
    assert rows(licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == rows(sql(licenses.OP7_SQL, documents=pandas_docs()))


def test_licenses_positions_must_meet_and_notices_score(spark):
    bsd = next(t for t in licenses.TEMPLATES if t.label == "bsd-3-clause").notice
    mit = next(t for t in licenses.TEMPLATES if t.label == "mit-text").notice
    cases = {
        bsd.upper(): "bsd-3-clause", mit.replace(" ", "\n\t* ").replace("merge", "MERGE,"): "mit-text", "general gnu license public": "", "gnu general public license": "gpl", "the license, apache": "",
        "to deal in the software without restriction": "", "mozilla public license": "", "Licensed under the Apache License, Version 2.0": "apache,apache-2.0", "MIT license mit LICENSE": "mit", "é " * 200_000 + "cc by": "cc-by", "gnu " * 50_000: "",
    }
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(cases)], "doc_id long, text string, hits string")
    got = licenses.scan_licenses(df).orderBy("doc_id").collect()
    assert [r.labels for r in got] == list(cases.values()) and {r.hits for r in got} == {"mine"} and [r.text for r in got] == list(cases)
    assert got[8].n_base == 2 and (got[8].first_word, got[8].last_word) == (0, 2) and got[0].score == 1.0


def test_mixing_matches_sql_and_meets_targets(docs):
    got = mixing.mix_digest(docs).toPandas()
    assert rows(got) == rows(sql(mixing.OP8_SQL, documents=pandas_docs()))
    assert (got.taken <= 2 * got["size"]).all()
    source = got.merge(pandas_docs()[["doc_id", "source"]]).fillna({"source": "~"})
    for _, g in source.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) <= 4


def test_mixing_tree_splits_quotas(spark):
    """Totals differ by one at most, quotas are exact, and a source's blocks on one side are hypergeometric."""
    quotas = {"1a": 100, "1b": 7, "1d": 31}
    draws = spark.createDataFrame([(k, i) for k, n in quotas.items() for i in range(n)], "name string, idx long")
    for shards in (1, 2, 5, 6):
        tree = mixing.split_tree(draws, shards, 1).toPandas()
        assert tree.groupby("name").many.sum().to_dict() == quotas
        each = tree.groupby("shard").many.sum()
        assert len(each) == shards and each.max() - each.min() <= 2
    left = [mixing.split_tree(spark.createDataFrame([("1g", i) for i in range(30)] + [("1b", i) for i in range(70)], "name string, idx long"), 2, seed).where("name = '1g' and shard = 0").first() for seed in range(25)]
    assert 13 <= sum(r.many if r else 0 for r in left) / 25 <= 17  # 50 of 100 drawn, 30 good: 15 +- 2.3 / 5


def test_mixing_draws_are_disjoint_and_digest_is_of_the_mixture(docs, monkeypatch):
    planned = mixing.plan_mix(mixing.sized(docs, ["doc_id", "source", "text"]))
    drawn = mixing.mixture(planned, "text").select("doc.doc_id", "shard", "pass", "words", "place", "text").toPandas()
    taken = planned.select("doc.doc_id", "taken").toPandas().set_index("doc_id").taken.to_dict()
    assert drawn.groupby("doc_id").words.sum().to_dict() == {k: v for k, v in taken.items() if v}
    assert not drawn.duplicated(["doc_id", "pass"]).any()
    assert all(len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) == n for t, n in zip(drawn.text, drawn.words, strict=True))
    got = mixing.mix_digest(docs).toPandas()
    assert got.shards.str.split(",").explode().nunique() >= 8 and got.taken.sum() == drawn.words.sum()
    whole = mixing.mixture
    monkeypatch.setattr(mixing, "mixture", lambda planned: whole(planned).where("shard <> 3"))
    assert mixing.mix_digest(docs).toPandas().taken.sum() == drawn.words[drawn.shard != 3].sum() < drawn.words.sum()


def test_mixing_many_sources_and_null_ids(spark):
    texts = [(None if i % 3 == 0 else i, "w " * (i % 40), "en", f"host{i % 50}" if i % 50 else None, 0) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_digest(df).drop("places", "shards").toPandas()
    want = sql(mixing.OP8_SQL, documents=pd.DataFrame(texts, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})).drop(columns=["places", "shards"])
    assert got.taken.sum() == want.taken.sum() and (got.taken <= 2 * got["size"]).all()
    given = got[got.doc_id.notna()]
    assert rows(given) == rows(want[want.doc_id.notna()])
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) <= 50


URLS = [
    "http://a.example.com/en/71", "http://example.com/en/6", "https://EXAMPLE.com/en/7?x", "http://notexample.net/de/9", "x.net/de/1", None, "", "ftp://", "http://net/de/8", "http://b.example.net/de/81#t", "http://ads.x.org/es/", "http://casino.example.info/?a://b", "a://b://example.com/en/7",
    "http://example.com/en/7\n", "http://spam.x.com/en/1", "http://x.info/ads/1", "http://x.info/loads/1", "http://x.info/a/b.PNG?x", "http://x.info/a.png/b", "http://x.info/?a=1&utm_source=b", "http://x.info/utm_source=b", "http://poker-online.info", "http://x.info/free-porn", "http://x.info/user/login.php",
    "http://securepubads.doubleclick.net/x", "http://doubleclick", "http://x.info/wp-login.php", "http://x.info/freeporn/", "http://google-analytics.com/", "http://google.info/analytics", "http://essex.info/", "http://x.info/" + "a/" * 30_000 + "ads", "é" * 50_000,
]


def test_url_filters_match_sql(spark):
    df = [(i, u) for i, u in enumerate([*URLS, *URLS[:2]])]
    pages = spark.createDataFrame(df, "page_id long, url string")
    got = urlfilter.filter_urls(pages, urlfilter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")
    assert rows(got) == rows(sql(urlfilter.OP9_SQL, pages=pd.DataFrame(df, columns=["page_id", "url"])))
    verdict = {URLS[r.page_id]: r.verdict for r in got.collect() if r.page_id < len(URLS)}
    blocked = [u for u in URLS if verdict[u] == "block"]
    assert {"http://x.info/ads/1", "http://poker-online.info", "http://x.info/a/b.PNG?x", "http://x.info/user/login.php", "http://google-analytics.com/"} <= set(blocked)
    assert not {"http://x.info/loads/1", "http://essex.info/", "http://x.info/a.png/b", "http://google.info/analytics", "http://x.info/utm_source=b"} & set(blocked)


#: The contract's list, written out: what the operator and its SQL have in common can't hide a wrong word from it.
CONTRACT_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def test_url_verdicts_are_those_of_the_contract(spark):
    """Every rule at its host, at subdomains (some of which patterns block), with longer paths, and where it nearly fits."""

    def judged(url):
        rest = url.partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path, host = re.match("[^?#]*", rest[len(host) :])[0], host.lower()
        fit = [(len(h + p), h + p, v) for v, h, p in CONTRACT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fit)[1:]) if fit else (host, path, None, None)

    hosts = [s + h for _, h, _ in CONTRACT_RULES for s in ("", "a.", "A.B.", "casino.", "ads.", "not")]
    paths = [p + e for _, _, p in CONTRACT_RULES for e in ("", "1", "x/y.png", "?a://b", "#t")] + ["", "/", "/de", "/DE/8", "/x/de/8"]
    df = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in dict.fromkeys(hosts) for p in paths)]
    got = urlfilter.filter_urls(spark.createDataFrame(df, "page_id long, url string"), urlfilter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()
    by_sql = sql(urlfilter.OP9_SQL, pages=pd.DataFrame(df, columns=["page_id", "url"]))
    want = {i: judged(u) for i, u in df}
    assert {(r, v) for *_, r, v in want.values()} == {(h + p, v) for v, h, p in CONTRACT_RULES} | {(None, None)}
    for table in (got, by_sql.astype(object).where(by_sql.notna(), None).itertuples(index=False)):
        found = {i: (h, p, r, v if r else None) for i, h, p, r, v in table}
        assert found == want


def test_url_rules_run_only_where_fetched(spark):
    """A rule is filed under its rarest token, and runs on URLs that have all of its tokens and on no others."""
    urls = [f"http://shop{i}.com/buy/online" for i in range(40)] + ["http://x.com/buy-replica", "http://casino.x.com/", "http://poker.online.x.com/en/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = urlfilter.rule_table(spark)
    got = urlfilter.fetched(df, rules).collect()
    needs = {r.id: set(r.tokens) for r in rules.collect()}
    tokens = {u: {t for t in re.split("[^0-9a-z]+", u) if t} for u in urls}
    want = {(u, i) for u in urls for i, n in needs.items() if n <= tokens[u]}
    assert {(r.url, r.id) for r in got} == want and len(got) == len(want) < len(urls) * len(needs) / 100
    assert len(needs) > 250 and sum(len(n) > 1 for n in needs.values()) > 90
    fits = {(u, r.id) for u in urls for r in rules.collect() if re.search(r.pattern, u)}
    assert fits <= want


TALK = "conv_id long, turn long, role string, text string"


def test_quotes_match_sql(spark):
    talk = [
        (1, 0, "u", "Hello there\n\nsecond  par"), (1, 1, "a", "> Hello there\nHi!"), (1, 1, "a", "> Hello there\nHi!"), (1, 2, "u", ">> hello there\n> hi!\nok fine"), (1, 3, "a", "> ok fine\nbye\n> unknown"),
        (1, 4, "u", None), (1, 5, "u", "> second par\n\n> Hello there\nboth"), (2, 0, "u", "> ok fine\nx"), (2, 1, "u", ""), (3, 0, "u", "same"), (3, 1, "u", "same"), (3, 2, "u", "> same\nsame"),
        (4, 0, "u", "first line\nsecond line\nthird line"), (4, 1, None, "> other\n> second line\nright"), (4, 2, "u", "> first line\nwrong"), (4, 3, "u", "\t> > right\n>\t\n> wrong\n>x\nagain"),
    ]
    linked = quotes.link_quotes(spark.createDataFrame(talk, TALK))
    table = pd.DataFrame(talk, columns=["conv_id", "turn", "role", "text"])
    assert rows(quotes.conversations(linked)) == rows(sql(quotes.PLAIN_SQL, conversations=table))
    by = {(r.message.conv_id, r.message.turn): r for r in linked.collect()}
    assert by[1, 2].reply_to == 1 and by[1, 2].quoted == [0, 1] and by[1, 2].depth == 2 and by[1, 5].reply_to == 0 and by[2, 0].reply_to is None
    assert by[4, 1].reply_to == 0 and by[4, 2].reply_to == 0 and by[4, 3].reply_to == 2 and by[4, 3].quoted == [1, 2] and by[4, 1].own_text == "right"
    text = quotes.conversations(linked).where("conv_id = 1").first()
    assert text.turns == "0,1,1,2,3,5,4" and ">" not in text.text and text.text.startswith("u: Hello there\n\nsecond  par\n\na: Hi!")
    nulls = quotes.link_quotes(spark.createDataFrame([(None, 1, "u", "> a"), (None, 1, "u", "a"), (1, None, "u", "a"), (1, None, None, None)], TALK))
    assert nulls.count() == 4 and sorted(r.n_messages for r in quotes.conversations(nulls).collect()) == [2, 2]


def test_quotes_are_planted_and_all_linked(spark):
    rng = random.Random(16)
    word = lambda: f"w{rng.randrange(10**6)}"
    talk = [(c, t, "u", "\n".join(" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4)))) for c in range(12) for t in range(9)]
    planted = quotes.with_quotes(spark.createDataFrame(talk, TALK))
    table = pd.DataFrame(talk, columns=["conv_id", "turn", "role", "text"])
    assert rows(quotes.conversations(quotes.link_quotes(planted))) == rows(sql(quotes.OP3_SQL, conversations=table))
    got = quotes.link_quotes(planted).collect()
    assert {(r.message.conv_id, r.message.turn): r.own_text for r in got} == {(c, t): x for c, t, _, x in talk}
    assert sum(r.reply_to is not None for r in got) > 50 and all(r.reply_to in (None, r.message.turn - 1) for r in got)


def test_quotes_long_reply_chain_and_long_text(spark):
    talk = [(1, i, "u", f"message number {i}" if not i else f"> message number {i - 1}\nmessage number {i}") for i in range(1300)]
    talk.append((2, 0, "u", "\n".join(f"{'> ' * (i % 5)}line {i}" for i in range(30_000))))
    linked = quotes.link_quotes(spark.createDataFrame(talk, TALK))
    got = linked.where("message.conv_id = 1").collect()
    assert sorted(r.depth for r in got) == list(range(1300)) and {r.thread for r in got} == {0}
    parts = quotes.conversations(linked).where("conv_id = 1").orderBy("part").collect()
    assert [r.n_messages for r in parts] == [500, 500, 300] and ",".join(r.turns for r in parts) == ",".join(map(str, range(1300)))


def test_decontamination_matches_sql(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [" ".join(word() for _ in range(n)) for n in (12, 12, 30, 41, 3, 5)] + ["a b a b a b a b a b a b", "", None]
    texts = [None, "", "short one"]
    for it in items[:7]:
        w = it.split()
        for change in (0, 1, 2):
            v = list(w)
            for _ in range(change):
                v[rng.randrange(len(v))] = word()
            texts.append(" ".join([*(word() for _ in range(rng.randrange(30))), *v, *(word() for _ in range(rng.randrange(30)))]))
    texts += [" ".join([*items[2].split()[:15], "in", "serted", *items[2].split()[15:]]), items[3].upper(), texts[-1]]
    benchmark = pd.DataFrame(list(enumerate(items)), columns=["item_id", "text"])
    documents = pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"])
    got = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    want = sql(decontaminate.OP6_SQL, documents=documents, benchmark=benchmark)
    assert len(want) > 8 and rows(got) == rows(want)


def window_brute(texts: list, items: list, percent: int = 80) -> dict:
    """Best similarity of any window of any text to any item, over all windows."""
    from collections import Counter

    out = {}
    for j, it in enumerate(items):
        w2 = it.split()
        k = min(5, len(w2))
        b = Counter(tuple(w2[i : i + k]) for i in range(len(w2) - k + 1))
        for d, t in enumerate(texts):
            w = t.split()
            n = min(len(w), len(w2))
            for s in range(len(w) - n + 1):
                a = Counter(tuple(w[i : i + k]) for i in range(s, s + n - k + 1))
                o = sum((a & b).values())
                if o and 100 * o >= percent * (sum(a.values()) + sum(b.values()) - o):
                    out[d, j] = max(out.get((d, j), 0), round(o / (sum(a.values()) + sum(b.values()) - o), 6))
    return out


def test_decontamination_recall_by_length_of_items(spark):
    """Against all windows: edited copies of items of 8 to 120 words, at similarities down to 0.8."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(4000)}"
    for n in (8, 16, 40, 120):
        items = [" ".join(word() for _ in range(n)) for _ in range(12)]
        texts = []
        for it in items:
            for edits in (0, 1, 1, 2, 2, 3):
                v = it.split()
                for _ in range(edits):
                    v[rng.choice([0, -1, rng.randrange(n)])] = word()
                texts.append(" ".join([*(word() for _ in range(rng.randrange(20))), *v, *(word() for _ in range(rng.randrange(20)))]))
        got = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
        got, want = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}, window_brute(texts, items)
        assert set(got) <= set(want) and all(want[x] == s for x, s in got.items())
        assert len(want) >= 12 and len(got) >= 0.95 * len(want), (n, len(got), len(want))


def test_decontamination_long_texts_and_many_items(spark):
    rng = random.Random(15)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [" ".join(word() for _ in range(rng.choice([10, 20, 30]))) for _ in range(5000)]
    ten = next(i for i in items if len(i.split()) == 10)
    texts = [" ".join([ten] * 10_000), " ".join(word() for _ in range(100_000)) + " " + items[7], None, "", " ".join(word() for _ in range(50)), "é " * 100_000]
    docs = spark.createDataFrame([(i if i < 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, items.index(ten)), (1, 7)} and all(r.similarity == 1 for r in got)
    assert next(r for r in got if r.doc_id == 1).start_word == 100_000
    words = [word() for _ in range(20_000)]
    long_item = spark.createDataFrame([(1, " ".join(words)), (2, "same " * 5000)], "item_id long, text string")
    texts = spark.createDataFrame([(1, "a b " + " ".join(words)), (2, "same " * 5003)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(texts, long_item).collect()} == {(1, 1, 1.0), (2, 2, 1.0)}


def test_decontamination_lanes_are_plain_simhash(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 300):
        x = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
        got = spark.createDataFrame([(x,)], "g array<bigint>").select(F.expr(decontaminate._simhash("g"))).first()[0]
        want = sum((2 * sum(v >> b & 1 for v in x) > n) << b for b in range(64))
        assert got == want - (1 << 64) * (want >> 63)


def test_fixity_finds_planted_faults(spark):
    pages = [(i, f"http://x/{i}", "é" * (i % 300) + "body" * (i % 50)) for i in range(3000)] + [(None, None, None), (5, "http://x/5", "again")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    a, b = fixity.faulty(df)
    got = fixity.fixity_audit(fixity.warc_records(df, a), fixity.warc_records(df, b))
    want = {i: {"00": "changed", "01": "missing", "02": "extra"}[s] for i in range(3000) if (s := hashlib.md5(str(i).encode()).hexdigest()[:2]) in ("00", "01", "02")}
    assert {r.record: r.fault for r in got.collect()} == want
    plain = pd.DataFrame(pages[:3000], columns=["page_id", "url", "html"])
    clean = spark.createDataFrame(pages[:3000], "page_id long, url string, html string")
    a, b = fixity.faulty(clean)
    audit = fixity.fixity_audit(fixity.warc_records(clean, a), fixity.warc_records(clean, b)).withColumnRenamed("record", "page_id").drop("nodes")
    assert rows(audit) == rows(sql(fixity.OP10_SQL, pages=plain))
    assert fixity.fixity_audit(fixity.warc_records(df), fixity.warc_records(df)).count() == 0


def test_fixity_odd_rows(spark):
    """Null ids, repeats, very long pages and names that clash."""
    pages = [(None if i % 5 == 0 else i // 2, None if i % 7 == 0 else f"http://x/{i}", None if i % 11 == 0 else "é" * (i % 90), "mine", "mine") for i in range(1200)] + [(9000, "http://long", "x" * 3_000_000, "mine", "mine")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, archive string, digest string")
    records = fixity.warc_records(df)
    assert records.count() == len(pages) and records.where("archive < 0").select("archive").distinct().count() > 100
    assert fixity.fixity_audit(records, fixity.warc_records(df)).count() == 0
    lost = fixity.warc_records(df, F.when(F.col("page_id") == 9000, F.lit(None).cast("string")).otherwise(fixity.warc_payload(F.col("url"), F.col("html"))))
    assert [(r.record, r.fault) for r in fixity.fixity_audit(records, lost).collect()] == [(9000, "missing")]


def test_clashing_names(spark, docs):
    """Columns named like an operator's own are replaced or kept, and never mixed up."""
    pages = spark.createDataFrame([(1, "http://x.com/en/1", "mine", "mine")], "page_id long, url string, host string, token string")
    row = urlfilter.filter_urls(pages, urlfilter.rule_table(spark)).first()
    assert (row.host, row.token, row.rule) == ("x.com", "mine", "com/en/")
    talk = spark.createDataFrame([(1, 0, "a", "mine", "mine", "mine"), (1, 1, "> a\nb", "mine", "mine", "mine")], "conv_id long, turn long, text string, own string, path string, passages string")
    rows_ = quotes.link_quotes(talk).orderBy("message.turn").collect()
    assert [(r.message.own, r.message.path, r.message.passages) for r in rows_] == [("mine",) * 3] * 2 and rows_[1].reply_to == 0 and rows_[1].own_text == "b"
    named = docs.withColumns({c: F.lit("mine") for c in ("size", "taken", "spans", "labels", "key", "token", "n_words", "h", "id", "t")})
    assert pii.find_pii(named).filter("spans = 'mine'").count() == 0
    assert licenses.scan_licenses(named).filter("labels = 'mine'").count() == 0
    assert jaccard.jaccard_join(named).count() == docs.count()
    assert dict(quality.clean_lines(named).dtypes)["n_words"] == "bigint"
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6", "mine")], "item_id long, text string, id string")
    assert decontaminate.contaminated(named, items).count() == 0
    planned = mixing.plan_mix(named.withColumn("size", mixing.word_count(F.col("text"))))
    assert dict(planned.dtypes)["taken"] == "bigint" and planned.where("doc.taken <> 'mine'").count() == 0
