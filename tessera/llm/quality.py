"""Quality rules, line first: lines that fail a rule go, then texts that lost too much."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.arrowtext import Words, byte_hashes, mix, pieces, words
from tessera.llm.shared import map_arrow

#: Whole lines of a page's furniture, without case and the marks and white space around them (fixed values).
BOILERPLATE = (
    "accept all", "accept all cookies", "accept cookies", "advertisement", "all rights reserved", "back to top", "click here", "comments are closed", "contact us",
    "continue reading", "cookie policy", "cookie settings", "edit this page", "follow us", "forgot password", "leave a comment", "load more", "log in", "log out", "main menu",
    "next page", "no comments", "previous page", "print this page", "privacy policy", "read more", "related articles", "related posts", "reply", "report abuse", "search",
    "see also", "share this", "share on facebook", "share on twitter", "show more", "sign in", "sign up", "site map", "skip to content", "skip to main content",
    "subscribe", "subscribe now", "terms and conditions", "terms of service", "terms of use", "toggle navigation", "view all",
)
#: Phrases that make a line of at most SHORT words furniture (fixed values).
PHRASES = (
    "all rights reserved", "by continuing to use this site", "cookie policy", "enable javascript", "javascript is disabled", "lorem ipsum", "powered by wordpress",
    "privacy policy", "subscribe to our newsletter", "terms of service", "terms of use", "this site uses cookies", "we use cookies",
)
SHORT = 12
#: Words that part the entries of a menu or a path, besides bars (fixed values).
SEPARATORS = (">", "»", "›", "•", "·", "/", "::", "→")
#: A line has sentences if one ends in it, or if the next line goes on with a small letter; lines of fewer words are headings or entries.
ENDED = r"""[.!?:;…。！？]["'”’»)\]]*(?:\s|$)"""
CONTINUES = r"^\s*\p{Ll}"
LEAST_UNENDED = 6
_WHOLE = rf"(?i)^[^\pL\pN]*(?:{'|'.join(BOILERPLATE)})[^\pL\pN]*$"
_INSIDE = rf"(?i)\b(?:{'|'.join(PHRASES)})\b"
_MARKS = r"^[^\pL\pN]+$"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC0:] = True  # the first byte of each character beyond ASCII
_TAIL = (np.arange(256) & 0xC0) == 0x80
_BAR, _MARK = ord("|"), ord("!")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in COUNTS]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("n_lines_removed", T.LongType()), T.StructField("words_removed", T.LongType()), T.StructField("clean_text", T.StringType())]
)


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _repeated(part: Words, texts: int) -> np.ndarray:
    """By text, the words inside windows of three words that the text has twice or more."""
    n = len(part.hash)
    if n < 3:
        return np.zeros(texts, np.int64)
    h, text, at = part.shingles(3)
    whole = part.count[text] >= 3
    h, text, at = h[whole], text[whole], at[whole]
    key = mix(h ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    at = at[order[twin]]
    hit = np.zeros(n, bool)
    for j in range(3):
        hit[at + j] = True
    return np.bincount(part.text[hit], minlength=texts)


def _matches(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def judge(texts: pa.Array, min_words: int, max_repeat: int, max_lost: float, symbol_share: float, upper_share: float) -> dict[str, np.ndarray | list]:
    """The counts and the verdict of each text; see ``clean_lines``."""
    total = len(texts)
    out: dict = {n: np.zeros(total, np.int64) for n in (*COUNTS, "n_lines_removed", "words_removed")}
    out["clean_text"] = [None] * total
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    _, separators = byte_hashes(SEPARATORS)
    for part in words(texts):
        k, here = len(part), slice(part.first, part.first + len(part))
        data, off = part.data, part.offsets
        chars, symbols = _sums(~_TAIL[data]), _sums(_SYMBOL[data])
        word_chars = chars[part.end] - chars[part.start]
        out["n_words"][here] = part.count
        out["word_chars"][here] = np.bincount(part.text, word_chars, minlength=k).astype(np.int64)
        out["n_symbols"][here] = symbols[off[1:]] - symbols[off[:-1]]
        out["n_repeat_words"][here] = _repeated(part, k)
        # Lines: [begin, stop) between newlines and the ends of texts; as strings they keep their newline.
        breaks = np.flatnonzero(data == 10)
        begin = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
        stop = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
        m = len(begin)
        lines_by_text = 1 + np.bincount(np.searchsorted(off, breaks, "right") - 1, minlength=k)
        of = np.repeat(np.arange(k), lines_by_text)
        line_of_word = np.searchsorted(begin, part.start, "right") - 1
        n_words = np.bincount(line_of_word, minlength=m)
        upper, letters = _sums(_UPPER[data]), _sums(_LETTER[data])
        bars, marks = _sums(data == _BAR), _sums(data == _MARK)
        line = lambda s: s[stop] - s[begin]  # noqa: E731, B023
        length, size = np.maximum(line(chars), 1), np.maximum(n_words, 1)
        some = n_words > 0
        parted = np.bincount(line_of_word, np.isin(part.hash, separators), minlength=m).astype(np.int64)
        navigation = some & (n_words >= 3) & ((line(bars) + parted) * 4 >= size) & ((line(bars) > 0) | (parted >= 2))
        symbol = some & (line(symbols) > symbol_share * length)
        shout = some & (n_words >= 3) & (line(upper) > upper_share * np.maximum(line(letters), 1)) & (line(marks) * 2 > size)
        # A run of one word said over and over.
        same = np.zeros(len(part.hash), bool)
        if len(same) > 1:
            same[1:] = (part.hash[1:] == part.hash[:-1]) & (line_of_word[1:] == line_of_word[:-1])
        stutter = some & (n_words >= 6) & (2 * np.bincount(line_of_word, same, minlength=m) > n_words)
        strings = pa.Array.from_buffers(pa.large_string(), m, [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)])
        furniture = _matches(strings, _WHOLE) | (_matches(strings, _INSIDE) & (n_words <= SHORT)) | _matches(strings, _MARKS)
        goes_on = np.append(_matches(strings, CONTINUES)[1:], False)
        goes_on[:-1] &= of[1:] == of[:-1]
        unended = (n_words >= LEAST_UNENDED) & ~_matches(strings, ENDED) & ~goes_on
        fails = navigation | symbol | shout | stutter | (some & furniture) | unended
        lost = np.bincount(line_of_word, fails[line_of_word], minlength=m) if len(part.hash) else np.zeros(m)
        out["n_lines_removed"][here] = np.bincount(of, fails, minlength=k).astype(np.int64)
        out["words_removed"][here] = np.bincount(of, lost, minlength=k).astype(np.int64)
        key = mix(part.spans(begin, stop) ^ mix(of.astype(np.uint64) + np.uint64(1)))[some]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), np.int64)
        again[first] = 0
        out["n_dup_lines"][here] = np.bincount(of[some], again, minlength=k).astype(np.int64)
        first = np.searchsorted(of, np.arange(k + 1))
        for i in np.unique(of[fails]):
            a, b = first[i], first[i + 1]
            if valid[part.first + i]:
                out["clean_text"][part.first + i] = b"\n".join(data[begin[j] : stop[j]].tobytes() for j in range(a, b) if not fails[j]).decode()
    out["base_failed"] = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["words_removed"] <= max_lost * out["n_words"])
    return out


def clean_lines(
    docs: DataFrame, text: str = "text", *, min_words: int = 50, max_repeat: int = 50, max_lost: float = 0.3, symbol_share: float = 0.1, upper_share: float = 0.7, texts: bool = True
) -> DataFrame:
    """Judge every line of every text, drop failing lines, and reject texts that lose too much.

    A line fails as *navigation* (a bar or other separator to every four words
    at least), *marks* (more than ``symbol_share`` of its characters are
    symbols), *shouting* (more than ``upper_share`` capitals and an exclamation
    mark to every other word), *stutter* (most words repeat the one before),
    *boilerplate* (a phrase of ``BOILERPLATE`` alone, of ``PHRASES`` in a short
    line, or no letter or digit at all) or *unended* (a line of ``LEAST_UNENDED``
    words or more in which no sentence ends and that the next line doesn't go on
    with).  A text fails at once with fewer than
    ``min_words`` words or if words in repeated three-word windows are more
    than ``max_repeat`` percent, and else is kept if its failing lines hold at
    most ``max_lost`` of its words.

    Adds to each row, in order of ``COUNTS``, the counts, then ``base_failed``,
    ``kept``, ``n_lines_removed``, ``words_removed`` and ``clean_text`` (the
    text without failing lines; null for a null text).  Columns of docs with
    one of these names are replaced.  A null or empty text has no words and
    fails.  Rows stay as they are: repeated rows are judged alike; an empty
    table gives an empty one.  One pass, no shuffle.
    """
    added = [f.name for f in SCHEMA]
    keep = [c for c in docs.columns if c == text or c not in added]
    base = docs.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*base.schema.fields, *(f for f in SCHEMA if texts or f.name != "clean_text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            source = batch.column(keep.index(text))
            found = judge(source, min_words, max_repeat, max_lost, symbol_share, upper_share)
            columns = list(batch.columns)
            for f in SCHEMA:
                if f.name == "clean_text":
                    if texts:
                        kept = pa.array(found[f.name], source.type)
                        columns.append(pc.coalesce(kept, source))
                else:
                    columns.append(pa.array(found[f.name]))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return map_arrow(base, run, schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return op2_columns(clean_lines(docs, texts=False))


def op2_columns(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "n_lines_removed", "words_removed")


OP2_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as k from documents),
l as (select k, doc_id, t, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from d),
m as (select k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w, lead(line) over (partition by k order by i) as next,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as symbols,
    length(line) - length(replace(line, '|', '')) as bars, length(line) - length(replace(line, '!', '')) as marks,
    length(line) - length(regexp_replace(line, '[A-Z]', '', 'g')) as upper,
    length(line) - length(regexp_replace(line, '[A-Za-z]|[^\x00-\x7F]', '', 'g')) as letters from l),
p as (select *, len(list_filter(w, lambda x: x in (PARTING))) as parted from m),
n as (select k, line, w, len(w) as n, (
    (len(w) >= 3 and (bars + parted) * 4 >= len(w) and (bars > 0 or parted >= 2)) or symbols > 0.1 * greatest(length(line), 1)
    or (len(w) >= 3 and upper > 0.7 * greatest(letters, 1) and marks * 2 > len(w))
    or (len(w) >= 6 and 2 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > len(w))
    or regexp_matches(line, 'WHOLE') or (len(w) <= 12 and regexp_matches(line, 'INSIDE')) or regexp_matches(line, 'MARKS')
    or (len(w) >= 6 and not regexp_matches(line, 'ENDED') and not coalesce(regexp_matches(next, 'CONTINUES'), false))
  ) and len(w) > 0 as fails from p),
by_line as (select k, sum(n) as n_words, sum(list_sum(list_transform(w, lambda x: length(x)))) as word_chars,
    count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines,
    count(*) filter (fails) as n_lines_removed, coalesce(sum(n) filter (fails), 0) as words_removed from n group by k),
ws as (select k, unnest(w) as w, generate_subscripts(w, 1) as i from (select k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d)),
win as (select k, i, w || chr(10) || lead(w) over s || chr(10) || lead(w, 2) over s as g from ws window s as (partition by k order by i)),
twice as (select k, i from (select k, i, count(*) over (partition by k, g) as c from win where g is not null) where c > 1),
rep as (select k, count(distinct i + j) as n_repeat_words from twice, (values (0), (1), (2)) as o(j) group by k),
a as (select d.doc_id, n_words, coalesce(word_chars, 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_lines_removed, words_removed
  from d join by_line using (k) left join rep using (k)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and words_removed <= 0.3 * n_words as kept,
  n_lines_removed::bigint as n_lines_removed, words_removed::bigint as words_removed from b
""".replace("PARTING", ", ".join(f"'{x}'" for x in SEPARATORS)).replace("WHOLE", _WHOLE).replace("INSIDE", _INSIDE).replace("MARKS", _MARKS).replace("ENDED", ENDED.replace("'", "''")).replace("CONTINUES", CONTINUES)
