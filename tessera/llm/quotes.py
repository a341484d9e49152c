"""Quotation linking: nested quotes are parsed, joined to the messages they come from, and cut out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded, discard, materialize, numbered

#: A line's quote marks: ``>`` signs at its start, with blanks between.
MARKS = r"^[ \\t]*(?:>[ \\t]*)+"
#: White space, alike in all regular expressions here.
SPACE = r"[ \\t\\r\\n\\f]"
#: Messages of a conversation that are one row of ``conversations``.
PART = 500


def _squeezed(text: str) -> str:
    """SQL for a text without case and with single blanks."""
    return f"trim(regexp_replace(lower({text}), '{SPACE}+', ' '))"


def parse(text: str) -> tuple[Column, Column]:
    """(passages, own): an array of (level, h, lines) and the text without quotes.

    Lines are split at newlines.  A line's level is the number of ``>`` at its
    start (0: the message's own words); neighbouring lines of one level make a
    passage; blank lines end one.  ``h`` hashes the passage and ``lines`` each of
    its lines, lower-cased and with white space squeezed to single blanks.
    ``own`` joins the lines of level 0 and trims white space around them; it is
    null for a null text.
    """
    lines = rf"transform(split(coalesce({text}, ''), '\n', -1), x -> struct(length(regexp_replace(regexp_extract(x, '{MARKS}', 0), '[^>]', '')) as level, regexp_replace(x, '{MARKS}', '') as line))"
    lines = f"transform({lines}, x -> struct(x.level as level, x.line as line, x.line rlike '^{SPACE}*$' as blank))"
    # The arrays of lines, and of the lines at which passages begin, are bound to names by an array of one.
    begins = "filter(sequence(0, size(l) - 1), i -> not l[i].blank and (i = 0 or get(l, i - 1).blank or get(l, i - 1).level <> l[i].level))"
    passage = "named_struct('level', l[b].level, 'lines', filter(slice(l, b + 1, coalesce(get(s, j + 1), size(l)) - b), x -> not x.blank))"
    runs = f"transform(array({lines}), l -> transform(array({begins}), s -> transform(s, (b, j) -> {passage}))[0])[0]"
    hashed = f"transform({runs}, r -> named_struct('level', r.level, 'h', xxhash64('p', {_squeezed('array_join(transform(r.lines, x -> x.line), chr(10))')}), 'lines', transform(r.lines, x -> xxhash64('l', {_squeezed('x.line')}))))"
    own = rf"regexp_replace(array_join(transform(filter({lines}, x -> x.level = 0), x -> x.line), '\n'), '^{SPACE}+|{SPACE}+$', '')"
    return F.expr(hashed), F.expr(f"if({text} is null, null, {own})")


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Messages without quotes, and which message each one answers.

    A quoted passage is linked to the earliest message of its conversation that
    has the same passage among its own words, or as all of them, and an earlier
    turn; a passage without one, to that of the first of its lines which is a
    line of an earlier message.  A message replies to the message of its first
    linked passage of least level; deeper levels name further messages it quotes.

    Returns ``message`` (a struct of all columns of messages, whatever their
    names), ``reply_to`` (turn; null: it starts a thread), ``quoted`` (turns
    linked, sorted), ``n_quotes`` (quoted passages), ``n_linked`` (those linked),
    ``max_level``, ``thread`` (turn of the thread's first message), ``depth``
    (replies from there) and ``own_text``.

    A null text has null own_text and no quotes.  A message with a null
    conversation or turn links with nothing and is a thread of its own.  Messages
    that repeat a turn share its links.  An empty table gives an empty one.
    Quotes of a passage that many messages have meet one row of its earliest
    place in the conversation, never all of them; what is joined is dealt out by
    conversation and passage, or conversation and turn.
    """
    col = lambda c: F.col(f"`{c}`")
    quoted = "`" + text.replace("`", "``") + "`"
    passages, own = parse(quoted)
    parsed = messages.select(F.struct(*[col(c) for c in messages.columns]).alias("message"), col(conversation).alias("c"), col(turn).alias("t"), F.explode(F.array(F.struct(passages.alias("p"), own.alias("own")))).alias("x"))
    parsed = materialize(parsed.select("message", "c", "t", "x.p", F.col("x.own").alias("own_text")), "quotes-parsed")
    keyed = parsed.where("c is not null and t is not null")
    quotes = keyed.where("exists(p, x -> x.level > 0)").select("c", "t", F.posexplode("p").alias("i", "x")).where("x.level > 0")
    quotes = quotes.select("c", "t", "i", "x.level", F.explode(F.expr("concat(array(struct(0 as k, x.h as h)), transform(x.lines, (y, j) -> struct(j + 1 as k, y as h)))")).alias("y"))
    quotes = materialize(quotes.select("c", "t", "i", "level", "y.k", "y.h").distinct(), "quotes", few=True)
    # Only passages and lines that someone quotes are looked for.
    wanted = bounded(quotes.select("c", "h").distinct())
    whole = F.expr(f"array(xxhash64('p', {_squeezed('own_text')}))")
    mine = F.array_distinct(F.concat(whole, F.expr("flatten(transform(filter(p, x -> x.level = 0), x -> array_append(x.lines, x.h)))")))
    mine = keyed.where("own_text <> ''").select("c", "t", F.explode(mine).alias("h"))
    origin = mine.join(wanted, ["c", "h"], "left_semi").groupBy("c", "h").agg(F.min("t").alias("origin"))
    linked = quotes.join(origin, ["c", "h"]).where(F.col("origin") < F.col("t"))
    linked = linked.groupBy("c", "t", "i").agg(F.min_by("origin", "k").alias("origin"), F.min("level").alias("level"))
    replies = linked.groupBy("c", "t").agg(F.min_by("origin", F.struct("level", "i")).alias("reply_to"), F.sort_array(F.collect_set("origin")).alias("quoted"), F.count(F.lit(1)).alias("n_linked"))
    replies = materialize(replies, "quotes-replies", few=True)
    extra = replies.join(threads(replies), ["c", "t"]).select(F.col("c").alias("c2"), F.col("t").alias("t2"), "reply_to", "quoted", "n_linked", "thread", "depth")
    extra = bounded(materialize(extra, "quotes-extra", few=True))
    joined = parsed.join(extra, (F.col("c") == F.col("c2")) & (F.col("t") == F.col("t2")), "left")
    return joined.select(
        "message",
        "reply_to",
        F.coalesce("quoted", F.expr(f"cast(array() as array<{dict(messages.dtypes)[turn]}>)")).alias("quoted"),
        F.expr("size(filter(p, x -> x.level > 0))").cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.coalesce(F.expr("array_max(transform(p, x -> x.level))"), F.lit(0)).cast("bigint").alias("max_level"),
        F.coalesce("thread", "t").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        "own_text",
    )


def threads(replies: DataFrame) -> DataFrame:
    """(c, t, thread, depth): the first message of each reply's thread and the replies from there, by doubling.

    A round adds to every unfinished way up that of its end, so a chain of n
    replies takes log2(n) rounds, each a written table of one short row a reply.
    """
    state = replies.select("c", "t", F.col("reply_to").alias("thread"), F.lit(1).cast("bigint").alias("depth"))
    while True:
        ends = state.select(F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = state.join(ends, (F.col("c") == F.col("c2")) & (F.col("thread") == F.col("t2")), "left")
        old, state = state, materialize(step.select("c", "t", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "quotes-threads", 32)
        if hasattr(old, "written"):
            discard(old)
        if not state.where("moved").limit(1).count():
            return state.drop("moved")


def conversations(linked: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", part: int = PART) -> DataFrame:
    """Conversations in the order of their replies: threads by their first message, a thread's messages by turn.

    One row for ``part`` messages of a conversation (most have one row): conv,
    part, n_messages, n_quotes, n_linked, max_depth, ``turns`` and ``replies``
    (the turn answered, or nothing) of the messages, comma-joined, and ``text``:
    "role: own words" of each, with blank lines between.  Messages are numbered
    over ranges of conversation, thread and turn, so a very long
    conversation is several tasks' work.  Messages that repeat a turn are in
    order of their texts; null conversations are one, null turns come first.
    """
    m = F.col("message")
    rows = linked.select(
        m.getField(conversation).alias("conv"), "thread", m.getField(turn).alias("turn"), F.coalesce("own_text", F.lit("")).alias("own"), F.coalesce(m.getField(role).cast("string"), F.lit("")).alias("role"), "reply_to", "n_quotes", "n_linked", "depth"
    )
    rows = numbered(rows, ["conv", "thread", "turn", "own", "role"], "number", "conversation-rows")
    first = bounded(materialize(rows.groupBy("conv").agg(F.min("number").alias("first")), "conversation-starts", few=True).withColumnRenamed("conv", "conv2"))
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("conv2"))).withColumn("at", F.col("number") - F.col("first"))
    text = F.concat("role", F.lit(": "), "own")
    rows = rows.groupBy("conv", F.expr(f"at div {part}").alias("part")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"), F.max("depth").alias("max_depth"),
        F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turn"), F.coalesce(F.col("reply_to").cast("string"), F.lit("")).alias("reply"), text.alias("text")))).alias("l"),
    )
    joined = lambda c, by: F.array_join(F.col(f"l.{c}"), by)
    return rows.select(F.col("conv").alias(conversation), "part", "n_messages", "n_quotes", "n_linked", "max_depth", joined("turn", ",").alias("turns"), joined("reply", ",").alias("replies"), joined("text", "\n\n").alias("text"))


def with_quotes(messages: DataFrame) -> DataFrame:
    """Messages that quote earlier ones as mail programs do, by the first digit of the MD5 of conversation and turn.

    0 to 5: the message before, whole; 6, 7: that one and the one before it, a level deeper; 8, 9: the first
    line of the message before; a, b: the message before, and something that nobody wrote; others are as they were.
    """
    texts = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("earlier"))
    back = lambda n: texts.select(F.col("conv_id").alias(f"c{n}"), (F.col("turn") + n).alias(f"t{n}"), F.col("earlier").alias(f"e{n}"))
    joined = messages
    for n in (1, 2):
        joined = joined.join(back(n), (F.col("conv_id") == F.col(f"c{n}")) & (F.col("turn") == F.col(f"t{n}")), "left")
    quote = lambda text, marks: f"concat('{marks}', replace({text}, chr(10), concat(chr(10), '{marks}')))"
    sign = "substr(md5(concat(cast(conv_id as string), '|', cast(turn as string))), 1, 1)"
    return joined.withColumn("text", F.expr(f"""case when text is null or e1 is null then text
        when {sign} between '0' and '5' then concat({quote('e1', '> ')}, chr(10), chr(10), text)
        when {sign} in ('6', '7') and e2 is not null then concat({quote('e2', '> > ')}, chr(10), {quote('e1', '> ')}, chr(10), chr(10), text)
        when {sign} in ('8', '9') then concat('> ', split(e1, chr(10))[0], chr(10), chr(10), text)
        when {sign} in ('a', 'b') then concat({quote('e1', '>')}, chr(10), text, chr(10), '> nobody wrote this line of turn ', cast(turn as string))
        else text end""")).drop("c1", "t1", "e1", "c2", "t2", "e2")


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, with quotes planted by rule (they have none of their own), linked and in reply order."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations(link_quotes(with_quotes(messages)))


def _sql(messages: str) -> str:
    squeezed = lambda x: rf"trim(regexp_replace(lower({x}), '[ \t\r\n\f]+', ' ', 'g'))"
    return rf"""
with recursive m as ({messages}),
l as (select k, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from m),
v as (select *, len(regexp_replace(regexp_extract(x, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) as level, regexp_replace(x, '^[ \t]*(?:>[ \t]*)+', '') as line from l),
w as (select *, regexp_matches(line, '^[ \t\r\n\f]*$') as blank from v),
g as (select *, sum(case when blank or level is distinct from plevel or pblank then 1 else 0 end) over (partition by k order by i) as g from (select *, lag(level) over o as plevel, coalesce(lag(blank) over o, true) as pblank from w window o as (partition by k order by i))),
p as (select k, conv_id, turn, g, min(i) as i, any_value(level) as level, {squeezed("string_agg(line, chr(10) order by i)")} as passage from g where not blank group by k, conv_id, turn, g),
pl as (select g.k, g.conv_id, g.turn, p.i, g.level, g.i as line_no, {squeezed("g.line")} as passage from g join p using (k, g) where not blank),
own as (select k, any_value(conv_id) as conv_id, any_value(turn) as turn, regexp_replace(coalesce(string_agg(line, chr(10) order by i) filter (level = 0), ''), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') as own from v group by k),
src as (select conv_id, turn, passage from p where level = 0 union select conv_id, turn, {squeezed("own")} from own where own <> ''),
src_l as (select conv_id, turn, passage from pl where level = 0),
q0 as (select p.conv_id, p.turn, p.i, p.level, min(s.turn) as origin from p join src s on s.conv_id = p.conv_id and s.passage = p.passage where p.level > 0 group by all),
q1 as (select p.conv_id, p.turn, p.i, p.level, p.line_no, min(s.turn) as origin from pl p join src_l s on s.conv_id = p.conv_id and s.passage = p.passage where p.level > 0 group by all),
q as (select conv_id, turn, i, level, origin, 0 as n from q0 where origin < turn union all select conv_id, turn, i, level, origin, line_no from q1 where origin < turn),
b as (select conv_id, turn, i, any_value(level) as level, arg_min(origin, n) as origin from q group by conv_id, turn, i),
r as (select conv_id, turn, arg_min(origin, level * 1000000 + i) as reply_to, count(*) as n_linked from b group by conv_id, turn),
path(conv_id, turn, thread, depth) as (select conv_id, turn, reply_to, 1 from r union all select path.conv_id, path.turn, r.reply_to, depth + 1 from path join r on r.conv_id = path.conv_id and r.turn = path.thread),
top as (select conv_id, turn, arg_max(thread, depth) as thread, max(depth) as depth from path group by conv_id, turn),
f as (select m.k, m.conv_id, m.turn, coalesce(m.role, '') as role, r.reply_to, coalesce(r.n_linked, 0) as n_linked, (select count(*) from p where p.k = m.k and level > 0) as n_quotes,
  coalesce(top.thread, m.turn) as thread, coalesce(top.depth, 0) as depth, case when m.text is null then '' else own.own end as own
  from m join own using (k) left join r on r.conv_id = m.conv_id and r.turn = m.turn left join top on top.conv_id = m.conv_id and top.turn = m.turn),
n as (select *, row_number() over (partition by conv_id order by thread nulls first, turn nulls first, own, role) - 1 as pos from f)
select conv_id, (pos // 500)::bigint as part, count(*)::bigint as n_messages, sum(n_quotes)::bigint as n_quotes, sum(n_linked)::bigint as n_linked, max(depth)::bigint as max_depth,
  string_agg(coalesce(turn::varchar, ''), ',' order by pos) as turns, string_agg(coalesce(reply_to::varchar, ''), ',' order by pos) as replies, string_agg(role || ': ' || own, chr(10) || chr(10) order by pos) as text
from n group by conv_id, pos // 500
"""


_PLANTED = r"""select k, conv_id, turn, role, case when text is null or e1 is null then text
    when sign between '0' and '5' then '> ' || replace(e1, chr(10), chr(10) || '> ') || chr(10) || chr(10) || text
    when sign in ('6', '7') and e2 is not null then '> > ' || replace(e2, chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(e1, chr(10), chr(10) || '> ') || chr(10) || chr(10) || text
    when sign in ('8', '9') then '> ' || string_split(e1, chr(10))[1] || chr(10) || chr(10) || text
    when sign in ('a', 'b') then '>' || replace(e1, chr(10), chr(10) || '>') || chr(10) || text || chr(10) || '> nobody wrote this line of turn ' || turn
    else text end as text
  from (select x.*, y.e as e1, z.e as e2, substr(md5(x.conv_id::varchar || '|' || x.turn::varchar), 1, 1) as sign from (select *, row_number() over () as k from conversations) x
    left join (select conv_id, turn, min(text) as e from conversations group by conv_id, turn) y on y.conv_id = x.conv_id and y.turn = x.turn - 1
    left join (select conv_id, turn, min(text) as e from conversations group by conv_id, turn) z on z.conv_id = x.conv_id and z.turn = x.turn - 2)"""
OP3_SQL = _sql(_PLANTED)
#: The same over conversations that have quotes of their own.
PLAIN_SQL = _sql("select *, row_number() over () as k from conversations")
