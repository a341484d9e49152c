"""Licence scan: a positional index of rare licence words fetches templates, whose key phrases are then verified."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize

WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A label, a notice of words, and the key phrase in it that has to stand word for word."""

    label: str
    notice: str
    key: str
    base: bool = False


#: Notices of well-known licences, lower-cased and without marks (fixed values).
TEMPLATES = (
    Template("gpl", "this work is licensed under the gnu general public license", "gnu general public license", True),
    Template("apache", "licensed under the apache license", "apache license", True),
    Template("cc-by", "licensed under cc by", "cc by", True),
    Template("mit", "released under the mit license", "mit license", True),
    Template("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "you may not use this file except in compliance with the license"),
    Template("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the artistic license 2 0", "artistic license 2 0"),
    Template("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software without specific prior written permission"),
    Template("bsl-1.0", "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost software license version 1 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-attribution", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "eclipse public license"),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "general public license as published by the free software foundation either version 3"),
    Template("gpl-3.0-named", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose"),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "to deal in the software without restriction"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mozilla public license"),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    Template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without fee and without a written agreement is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose", "free and unencumbered software released into the public domain"),
    Template("wtfpl", "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document", "do what the fuck you want to public license"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "provided as is without any express or implied warranty in no event will the authors be held liable"),
)
#: Rare words of a template that are filed.
FILED = 3


def _words(text: str) -> F.Column:
    low = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, WORD_BREAK), "")


def _literal(x) -> str:
    if isinstance(x, str):
        return f"'{x}'"
    if isinstance(x, float):
        return f"{x!r}D"
    return f"array({', '.join(map(_literal, x))})" if isinstance(x, (list, tuple)) else str(x)


def _vocabulary(templates) -> list[str]:
    return sorted({w for t in templates for w in t.notice.split()})


def _offset(t: Template) -> int:
    """Where the key phrase begins in the notice."""
    key, notice = t.key.split(), t.notice.split()
    return next(j for j in range(len(notice)) if notice[j : j + len(key)] == key)


def word_weights(worded: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency, over all rows, of each word of the templates: ln((1 + rows) / (1 + rows with it)) + 1."""
    vocabulary = _vocabulary(templates)
    has = F.explode(F.array_append(F.array_distinct(F.col("hits.w")), "")).alias("word")
    # At most one row a word of the templates, whatever the number of rows.
    counts = {r.word: r["count"] for r in worded.select(has).groupBy("word").count().collect()}
    rows = counts.get("", 0)
    return {w: math.log((1 + rows) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}


def scan_licenses(docs: DataFrame, text: str = "text", *, templates=TEMPLATES, least: float = 0.5, texts: bool = True) -> DataFrame:
    """Adds to each row what licences its text names.

    Words are runs of letters and digits (every character beyond ASCII counts
    as one), A-Z lower-cased.  Of each template's key phrase up to ``FILED`` words of
    highest IDF over all texts (ties: least word, first place) are filed with
    their positions; phrases with fewer words file all.  A text's own words
    that are filed are looked up: postings of a
    template are places where the text would hold it by the relative position
    of a filed word, and only places at which the postings of all of the
    template's filed words meet are candidates.  A candidate stands if the key phrase
    does word for word.  Its score is the IDF-weighted share of the template's
    notice that stands at the same relative positions.  A template of the base
    set labels the text in any case, another one with a score of ``least`` or more.

    Adds ``n_words``, ``n_base`` (places of base key phrases), ``first_word``
    and ``last_word`` (their least and greatest start; null if none),
    ``base_labels``, ``labels`` (sorted, comma-joined) and ``score`` (greatest,
    0 if none; rounded to 6 places).  Columns of docs with these names are
    replaced; all others are kept, whatever their names.  A null or empty text
    has no words.  Repeated rows are judged alike; an empty table gives an empty
    one.  Without ``texts`` the text column is left out and texts are split
    once: the words that templates have are written with their places, and
    counted and looked up from there.  With it they are split twice, and
    nothing is written.  No shuffle but of word counts.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in docs.columns if c not in added or c == text]
    vocabulary = _vocabulary(templates)
    one_of = ", ".join(map(_literal, vocabulary))  # a list of literals is looked up by hash
    found = F.expr(f"""transform(array(w), w -> named_struct('n', size(w), 'hits', if(arrays_overlap(w, {_literal(vocabulary)}),
        filter(transform(w, (x, i) -> if(x in ({one_of}), named_struct('w', x, 'i', i), null)), x -> x is not null), cast(array() as array<struct<w: string, i: int>>))))[0]""")
    kept = [c for c in kept if texts or c != text]
    slim = docs.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in kept]).alias("doc"), _words(text).alias("w"))
    worded = slim.select("doc", F.explode(F.array(found)).alias("x")).select("doc", "x.n", "x.hits")
    if not texts:
        worded = materialize(worded, "license-words")
    weight = word_weights(worded, templates)
    keys, filed = [t.key.split() for t in templates], []
    for key in keys:
        best = sorted(range(len(key)), key=lambda j: (-weight[key[j]], key[j], j))[:FILED]
        filed.append([(key[j], j) for j in best])
    entries = [f"named_struct('word', {_literal(w)}, 't', {t}, 'at', {j}, 'of', {len(f)})" for t, f in enumerate(filed) for w, j in f]
    by_word = "map_from_entries(array(" + ", ".join(
        f"struct({_literal(w)}, array({', '.join(e for e in entries if e.startswith(f"named_struct('word', {_literal(w)},"))}))" for w in sorted({w for f in filed for w, _ in f})
    ) + "))"
    names = _literal(sorted({w for f in filed for w, _ in f}))
    filed_one = ", ".join(map(_literal, sorted({w for f in filed for w, _ in f})))
    # Postings, then places that every filed word of a template gives, each once.
    postings = f"""flatten(transform(filter(hits, h -> h.w in ({filed_one})), h -> transform(element_at({by_word}, h.w), e -> named_struct('t', e.t, 's', h.i - e.at, 'of', e.of))))"""
    scored = worded.withColumn("rows", F.expr(f"if(arrays_overlap(hits.w, {names}), array_sort({postings}), cast(array() as array<struct<t: int, s: int, of: int>>))"))
    same = "x.t = get(rows, i + x.of - 1).t and x.s = get(rows, i + x.of - 1).s"
    scored = scored.withColumn("places", F.expr(f"filter(rows, (x, i) -> x.s >= 0 and coalesce({same}, false))"))
    # The text's words at the places of templates: by position, so that phrase and notice are compared word by word.
    scored = scored.withColumn("at", F.expr("if(size(places) > 0, map_from_entries(transform(hits, h -> struct(h.i, h.w))), map_from_entries(cast(array() as array<struct<i: int, w: string>>)))"))
    lists = lambda x: _literal([list(v) for v in x])
    whole = f"forall(sequence(0, size(element_at({lists(keys)}, x.t + 1)) - 1), j -> element_at(at, x.s + j) <=> element_at({lists(keys)}, x.t + 1)[j])"
    scored = scored.withColumn("places", F.expr(f"filter(places, x -> {whole})"))
    notices = [t.notice.split() for t in templates]
    weights = [[weight[w] for w in n] for n in notices]
    offsets = _literal([_offset(t) for t in templates])
    share = f"""round(aggregate(sequence(0, size(element_at({lists(notices)}, x.t + 1)) - 1), 0.0D,
        (sum, j) -> sum + if(element_at(at, x.s - element_at({offsets}, x.t + 1) + j) <=> element_at({lists(notices)}, x.t + 1)[j], element_at({_literal(weights)}, x.t + 1)[j], 0.0D))
        / element_at({_literal([sum(w) for w in weights])}, x.t + 1), 6)"""
    scored = scored.select("doc", "n", F.expr(f"transform(places, x -> named_struct('t', x.t, 's', x.s, 'score', {share}))").alias("f"))
    is_base = _literal([i for i, t in enumerate(templates) if t.base])
    labels = _literal([t.label for t in templates])
    base_starts = f"transform(filter(f, x -> array_contains({is_base}, x.t)), x -> x.s)"
    label = lambda where: f"array_join(array_sort(array_distinct(transform(filter(f, x -> {where}), x -> element_at({labels}, x.t + 1)))), ',')"
    return scored.select(
        *[F.col("doc").getField(c).alias(c) for c in kept],
        F.expr("cast(n as bigint) as n_words"),
        F.expr(f"cast(size({base_starts}) as bigint) as n_base"),
        F.expr(f"cast(array_min({base_starts}) as bigint) as first_word"),
        F.expr(f"cast(array_max({base_starts}) as bigint) as last_word"),
        F.expr(label(f"array_contains({is_base}, x.t)") + " as base_labels"),
        F.expr(label(f"array_contains({is_base}, x.t) or x.score >= {least!r}D") + " as labels"),
        F.expr("coalesce(array_max(transform(f, x -> x.score)), 0.0D) as score"),
    )


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs, texts=False)


def _sql() -> str:
    rows = ", ".join(
        f"({i}, {t.base}, '{t.label}', {t.notice.split()!r}, {t.key.split()!r}, {next(j for j in range(99) if t.notice.split()[j : j + len(t.key.split())] == t.key.split())})"
        for i, t in enumerate(TEMPLATES)
    )
    vocabulary = ", ".join(f"'{w}'" for w in sorted({w for t in TEMPLATES for w in t.notice.split()}))
    return rf"""
with d as (select doc_id, row_number() over () as k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
n as (select count(*) as n from d),
v(word) as (select unnest([{vocabulary}])),
idf as (select word, ln((1.0 + (select n from n)) / (1.0 + count(k))) + 1 as weight from v left join (select distinct k, unnest(w) as word from d) using (word) group by word),
t(t, base, label, notice, key, o) as (values {rows}),
tw as (select t, unnest(notice) as word, generate_subscripts(notice, 1) as j from t),
total as (select t, sum(weight) as total from tw join idf using (word) group by t),
x as (select k, unnest(w) as word, generate_subscripts(w, 1) as i from d),
places as (select x.k, t.t, x.i as s from x join t on x.word = t.key[1] join d on d.k = x.k and d.w[x.i : x.i + len(t.key) - 1] = t.key),
scored as (select p.k, p.t, p.s, round(sum(case when p.s - t.o + tw.j - 1 >= 1 and d.w[p.s - t.o + tw.j - 1] = tw.word then weight else 0 end) / any_value(total), 6) as score
  from places p join t using (t) join d using (k) join tw using (t) join idf using (word) join total using (t) group by p.k, p.t, p.s),
f as (select k, count(*) filter (base) as n_base, min(s - 1) filter (base) as first_word, max(s - 1) filter (base) as last_word,
  string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) filter (base or score >= 0.5) as labels, max(score) as score
  from scored join t using (t) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score from d left join f using (k)
"""


OP7_SQL = _sql()
