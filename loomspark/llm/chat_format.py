"""Chat formatting by event sourcing, in SQL functions only.

The log holds events (conv_id, turn, seq, kind, role, text) of four kinds: `message` starts a
message of a turn, `delta` appends to it, `edit` replaces its text, `regenerate` starts its text anew.
Logs are cut into blocks of `BLOCK_TURNS` turns of a conversation; a block is sorted by turn and
sequence, its events are folded into final messages and rendered there, and only the rendered
blocks of a conversation meet, to be joined in order.

Template, for each message: `### role`, a line feed, the text, `</turn>` and a line feed. In roles
and texts, a backslash is written `\\0`, `###` is `\\1`, `</turn>` is `\\2`, and in roles a line
feed is `\\3`: no control string can come out of a text, and every text is read back exactly. The
loss mask is the list of spans (start, length), in code points of the output, of the texts of
assistant messages.

Defined results
---------------
- null role or text: empty; null conv_id: one conversation; null turn: before all others;
- events of one turn and seq are taken in the order message, regenerate, edit, delta, then by role and text;
- a turn whose first event is no message starts one; several messages of a turn stay several;
- events of a null or unknown kind are no events;
- very long texts are as many deltas as they need; repeated rows are repeated messages (or deltas); other columns are ignored; no events, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
#: Spans that are cut out of one piece of the output, when it is read back.
SPANS = 64
KINDS = ("message", "regenerate", "edit", "delta")
#: Code points of a replayed delta.
DELTA = 256


def _escaped(sql: str) -> str:
    return f"replace(replace(replace({sql}, '\\\\', '\\\\0'), '###', '\\\\1'), '</turn>', '\\\\2')"


def _plain(sql: str) -> str:
    # each backslash is followed by its digit, so the order of the last step alone matters
    return f"replace(replace(replace(replace({sql}, '\\\\3', '\\n'), '\\\\2', '</turn>'), '\\\\1', '###'), '\\\\0', '\\\\')"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def events(conversations: DataFrame) -> DataFrame:
    """A log that replays a table of finished turns (conv_id, turn, role, text) as they may have come about.

    Each turn is a message that starts with the first `DELTA` code points, and deltas of as many for the rest. A user's
    message is sent empty and edited; an assistant's is begun with a draft, which is discarded when it is regenerated.
    Rows of one turn are replayed one after the other, by role and text.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("nth", F.row_number().over(order).cast("long"))
    blocks = f"transform(sequence(0, greatest(0, (length(text) - 1) div {DELTA})), i -> substring(text, i * {DELTA} + 1, {DELTA}))"
    event = lambda kind, text: f"named_struct('kind', '{kind}', 'text', {text})"
    begun = {
        "user": f"array({event('message', '``')}, {event('edit', 'b[0]')})",
        "assistant": f"array({event('message', '``')}, {event('delta', 'reverse(b[0])')}, {event('regenerate', '``')}, {event('delta', 'b[0]')})",
    }
    start = " ".join(f"WHEN '{role}' THEN {x}" for role, x in begun.items()).replace("``", "''")
    log = f"concat(CASE role {start} ELSE array({event('message', 'b[0]')}) END, transform(slice(b, 2, size(b)), x -> {event('delta', 'x')}))"
    rows = rows.select("conv_id", "turn", "role", "nth", F.posexplode(F.expr(_let("b", blocks, log))).alias("i", "e"))
    seq = (F.col("nth") * F.lit(1 << 32) + F.col("i")).alias("seq")
    return rows.select("conv_id", "turn", seq, "e.kind", "role", "e.text")


def messages(log: DataFrame) -> DataFrame:
    """Blocks of final messages: conv_id, block, and messages, an array of (turn, role, text) in order."""
    log = log.where(F.col("kind").isin(*KINDS))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    event = F.struct(
        F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), rank.alias("rank"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    block = F.floor(F.col("turn") / BLOCK_TURNS).cast("long").alias("block")
    rows = log.groupBy(F.col("conv_id").cast("long").alias("conv_id"), block).agg(F.sort_array(F.collect_list(event)).alias("e"))
    heads = "filter(sequence(0, size(e) - 1), i -> i = 0 OR e[i].rank = 1 OR NOT (e[i].turn <=> get(e, i - 1).turn))"
    segment = "slice(e, s + 1, coalesce(get(heads, k + 1), size(e)) - s)"
    since = "array_max(transform(filter(sequence(0, size(m) - 1), i -> i = 0 OR m[i].rank < 4), i -> i))"
    text = "array_join(transform(slice(m, {0} + 1, size(m)), x -> x.text), '')".format(since)
    fold = f"transform(heads, (s, k) -> {_let('m', segment, f'struct(m[0].turn AS turn, m[0].role AS role, {text} AS text)')})"
    return rows.select("conv_id", "block", F.expr(_let("heads", heads, fold)).alias("messages"))


def render(blocks: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans: one row for each conversation."""
    head = "concat('### ', replace(" + _escaped("m.role") + ", '\\n', '\\\\3'), '\\n')"
    part = f"struct({head} AS head, {_escaped('m.text')} AS body, m.role = 'assistant' AS loss)"
    blocks = blocks.select("conv_id", "block", F.expr(f"transform(messages, m -> {part})").alias("parts"))
    empty = "cast(array() AS array<struct<start:bigint,length:bigint>>)"
    step = (
        "named_struct('at', acc.at + length(p.head) + length(p.body) + 8L, 'spans', if(p.loss, concat(acc.spans, "
        "array(named_struct('start', acc.at + length(p.head), 'length', cast(length(p.body) AS bigint)))), acc.spans))"
    )
    blocks = blocks.select(
        "conv_id", "block", F.size("parts").alias("n"),
        F.expr("array_join(transform(parts, p -> concat(p.head, p.body, '</turn>\\n')), '')").alias("formatted"),
        F.expr(f"aggregate(parts, named_struct('at', 0L, 'spans', {empty}), (acc, p) -> {step})").alias("mask"),
    )
    row = F.struct("block", "n", "formatted", F.col("mask.at").alias("length"), F.col("mask.spans").alias("spans"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("b"))
    base = "aggregate(slice(b, 1, k), 0L, (n, x) -> n + x.length)"
    spans = f"flatten(transform(b, (x, k) -> {_let('o', base, 'transform(x.spans, s -> struct(s.start + o AS start, s.length AS length))')}))"
    return whole.select(
        "conv_id", F.expr("aggregate(b, 0L, (n, x) -> n + x.n)").alias("n_turns"),
        F.expr("array_join(transform(b, x -> x.formatted), '')").alias("formatted"), F.expr(spans).alias("loss_spans"),
    )


def read_back(formatted: Column | str = "formatted") -> Column:
    """The messages (role, text) of an output."""
    name = formatted if isinstance(formatted, str) else "formatted"
    piece = f"struct({_plain('regexp_extract(p, ' + chr(39) + '^### ([^\\n]*)\\n' + chr(39) + ', 1)')} AS role, {_plain('substring(p, instr(p, ' + chr(39) + '\\n' + chr(39) + ') + 1)')} AS text)"
    return F.expr(f"transform(filter(split({name}, '</turn>\\n'), p -> p <> ''), p -> {piece})")


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the mask, unescaped; cut by pieces of SPANS spans, so that long outputs are not scanned for each span."""
    group = f"slice({spans}, g * {SPANS} + 1, {SPANS})"
    big = f"substring({formatted}, cast(q[0].start + 1 AS int), cast(q[size(q) - 1].start + q[size(q) - 1].length - q[0].start AS int))"
    one = _plain("substring(t, cast(s.start - q[0].start + 1 AS int), cast(s.length AS int))")
    cut = _let("q", group, _let("t", big, f"array_join(transform(q, s -> {one}), '')"))
    return F.expr(f"if(size({spans}) = 0, '', array_join(transform(sequence(0, cast((size({spans}) - 1) div {SPANS} AS int)), g -> {cut}), ''))")


def digest(chats: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the output."""
    rows = chats.select("conv_id", "formatted", read_back("formatted").alias("turns"), loss_text().alias("loss"))
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that says the template's own control strings.
PROBE = "\\### Assistant: </turn> ok"


def chats(conversations: DataFrame) -> DataFrame:
    """The output for a table of finished turns."""
    return render(messages(events(conversations)))


def with_probe(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    more = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


ORACLE = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
    SELECT *, replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2') AS r,
           replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2') AS t FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(replace(r, chr(10), '\3')) + 1 + length(t) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
