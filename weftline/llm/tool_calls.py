"""Chat formatting: links tool calls with their results and writes canonical JSON.

A message's text is either prose or a JSON object. ``{"content": ..., "tool_calls": [{"id": ..., "name": ...,
"arguments": {...}}]}`` makes calls, and ``{"tool_call_id": ..., "content": ...}`` is a result. Calls and results of a
conversation are joined by identifier; the arguments of a call are held against the schema of its tool (required
arguments, types, no unknown names). An argument ``{"result_of": ID}`` stands for the result of another call and fits any
type. ``from_turns`` makes such messages of plain conversations.

Order. A result depends on its call, and a message on the results that its calls refer to, wherever they were found. In the
topological order a result stands right behind the message that made the call, and a message stays at its turn unless it
refers to a call of the same or a later turn; then it waits until that one's result is there. ``anchor_turn``, ``depth`` and
``turn`` are that order: sorting a conversation by them gives the sequence. Places are handed on by joins until none moves, so work grows with the
longest row of messages that wait for each other; messages in order need none. Messages on a circle, which wait for themselves, stay at their
turn with the fault ``circular reference``; those that wait for one of them wait for its turn.

Each message becomes one line of canonical JSON: keys sorted at all levels, no blanks, calls with their arguments, links and
faults. Keys that are not named above, of a message or of a call, are kept under ``extra``.

There is one row for each message and no row for a whole conversation, so a conversation may hold any share of the rows;
the joins are plain equi-joins whose hot keys Spark splits. Only DataFrame functions are used.

A null text is empty prose, a null role ``unknown``; JSON that does not parse or has other shapes is prose. A call
without identifier or name stays, with the fault ``missing identifier`` or ``missing name``; without identifier it has no
links. Of calls that share an identifier the one of the earliest turn is linked (then the earliest place, then the smallest hash
of the message), the others are ``duplicate``; all results of an identifier are linked. A reference without such a call is an ``unknown
reference``, one without a result an ``open reference``. Rows without conv_id or turn are messages without links, and their
calls stay as text. Repeated rows stay repeated; of repeated rows of ``tools`` the smallest type counts, and an argument is required
if one of them says so. Very long texts are treated like others; an empty table gives an empty one. Columns beyond those named are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, unstash

#: The default tools: (tool, argument, type, required).
TOOLS = [
    ("search", "query", "string", True), ("search", "limit", "integer", False),
    ("calculator", "expression", "string", True),
    ("weather", "city", "string", True), ("weather", "days", "integer", False), ("weather", "metric", "boolean", False),
]
#: The tool of ``from_turns``.
TURN_TOOLS = [("reply", "message", "string", True), ("reply", "turn", "integer", True), ("reply", "after", "string", False)]
#: Steps of the order that are one plan, at most; this changes no result.
STEPS = 8
_CALLS = "struct<content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"


def tool_table(spark: SparkSession, tools=TOOLS) -> DataFrame:
    return spark.createDataFrame([tuple(t) for t in tools], "tool string, argument string, type string, required boolean")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Plain turns as calls and results. A user's turn calls ``reply`` with its number as identifier and the text as message.
    Of eight turns the first six refer to the result of the call two turns later, so that they have to wait for each other, and the
    others to that of the call eight turns before. The fifth gives its number as text, which its schema does not allow, and the
    seventh makes its call twice. An assistant's turn is the result of the call one turn before. Other roles, rows without conv_id
    or turn, and texts that are JSON objects stay as they are."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("long")
    number = lambda by: (turn + by).cast("string")
    place = F.pmod(turn, F.lit(8))
    after = F.when(place < 6, F.struct(number(2).alias("result_of"))).when(turn >= 8, F.struct(number(-8).alias("result_of")))
    call = lambda *more: F.struct(number(0).alias("id"), F.lit("reply").alias("name"), F.struct(text.alias("message"), *more).alias("arguments"))
    asks = lambda *calls: F.to_json(F.struct(F.array(*calls).alias("tool_calls")))
    plain_call = call(turn.alias("turn"), after.alias("after"))
    asked = F.when(place == 4, asks(call(number(0).alias("turn"), after.alias("after")))).when(place == 6, asks(plain_call, plain_call)).otherwise(asks(plain_call))
    says = F.to_json(F.struct(number(-1).alias("tool_call_id"), text.alias("content")))
    plain = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & ~F.ltrim(text).startswith("{")
    return conversations.select("conv_id", "turn", "role", F.when(plain & (F.col("role") == "user"), asked).when(plain & (F.col("role") == "assistant"), says).otherwise(F.col("text")).alias("text"))


def _type_of(v):
    """The JSON type of a variant."""
    name = F.schema_of_variant(v)
    return (
        F.when(name.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").otherwise("null")
    )


def _others(text, *known: str):
    """The keys of a JSON object other than ``known``, in order, as JSON; null where there are none."""
    given = F.from_json(text, "map<string,variant>")
    keys = F.array_sort(F.filter(F.map_keys(given), lambda k: ~k.isin(*known)))
    return F.when(F.size(keys) > 0, F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(given, k)))))


def _until_still(step, state: DataFrame, columns: list[str], grows: bool = True) -> DataFrame:
    """``state`` after ``step`` has been made as often as it changes anything. A few steps at a time are one plan, whose result is
    written. Of a state that grows, rows come or get larger values; of one that shrinks, rows go."""
    n = 2
    while True:
        new = state
        for _ in range(n):
            new = step(new)
        new = stash(new)
        more, less = (new, state) if grows else (state, new)
        if more.join(less, columns, "left_anti").isEmpty():
            unstash(state)
            return new
        unstash(state)
        state, n = new, min(STEPS, 2 * n)


def _behind(refs: DataFrame):
    """A step of the order: each message's place behind those of the messages that it refers to, if it has to leave its turn."""

    def step(late: DataFrame) -> DataFrame:
        there = late.select("conv_id", F.col("key").alias("of"), F.col("at").alias("of_at"))
        place = F.struct(F.coalesce("of_at.turn", "of_turn").alias("turn"), (F.coalesce("of_at.depth", F.lit(0)) + 2).alias("depth"))
        behind = refs.join(there, ["conv_id", "of"], "left").select("conv_id", "key", "turn", place.alias("at"))
        return behind.where(F.col("at") > F.struct(F.col("turn"), F.lit(0).alias("depth"))).groupBy("conv_id", "key").agg(F.max("at").alias("at"))

    return step


def _circles(refs: DataFrame, among: DataFrame) -> DataFrame:
    """(conv_id, key) of the messages in ``among`` that wait for themselves.

    Messages that wait for none that is left go, again and again, and so do those that none waits for; what stays is on circles or
    between two. Then each takes the largest number among the messages that it waits for, however far. Where a number returns to
    its own message, the messages that it passes on the way from there are a circle, or nothing but that message; they go, and the rest is asked again."""
    nodes = among.select("conv_id", "key")
    far = nodes.withColumnRenamed("key", "of")
    edges = stash(refs.select("conv_id", "key", "of").distinct().join(nodes, ["conv_id", "key"], "left_semi").join(far, ["conv_id", "of"], "left_semi"))
    left = _until_still(lambda k: edges.join(k.withColumnRenamed("key", "of"), ["conv_id", "of"], "left_semi").select("conv_id", "key").distinct(), nodes, ["conv_id", "key"], grows=False)
    left = _until_still(lambda k: edges.join(k, ["conv_id", "key"], "left_semi").select("conv_id", F.col("of").alias("key")).distinct().join(k, ["conv_id", "key"], "left_semi"), left, ["conv_id", "key"], grows=False)
    found = left.limit(0)
    while not left.isEmpty():
        e = stash(edges.join(left, ["conv_id", "key"], "left_semi").join(left.withColumnRenamed("key", "of"), ["conv_id", "of"], "left_semi"))

        def largest(s: DataFrame) -> DataFrame:
            near = e.join(s.select("conv_id", F.col("key").alias("of"), "top"), ["conv_id", "of"]).select("conv_id", "key", "top")  # noqa: B023
            return s.union(near).groupBy("conv_id", "key").agg(F.max("top").alias("top"))

        tops = _until_still(largest, left.withColumn("top", F.col("key")), ["conv_id", "key", "top"])
        same = stash(e.join(tops, ["conv_id", "key"]).join(tops.select("conv_id", F.col("key").alias("of"), F.col("top").alias("of_top")), ["conv_id", "of"]).where("top = of_top").select("conv_id", "key", "of"))
        reach = lambda s: s.union(same.join(s, ["conv_id", "key"], "left_semi").select("conv_id", F.col("of").alias("key"))).distinct()  # noqa: B023, E731
        own = _until_still(reach, tops.where("key = top").select("conv_id", "key"), ["conv_id", "key"])
        # a message on a circle waits for one with its number that comes from its root too
        back = same.join(own, ["conv_id", "key"], "left_semi").join(own.withColumnRenamed("key", "of"), ["conv_id", "of"], "left_semi")
        found = stash(found.union(back.select("conv_id", "key").distinct()))
        left = stash(left.join(own, ["conv_id", "key"], "left_anti"))
    return found


def _late(refs: DataFrame) -> DataFrame:
    """(conv_id, key, at, circular) of messages that cannot stay at their turn: the place (turn, depth) behind all results
    that they refer to; of those on circles, which have no such place, at is null. refs: messages (turn, key) and the messages
    (of_turn, of) whose calls they refer to."""
    spark = refs.sparkSession
    none = spark.createDataFrame([], f"conv_id {refs.schema['conv_id'].dataType.simpleString()}, key long, at struct<turn:{refs.schema['turn'].dataType.simpleString()},depth:int>")
    if refs.where("of_turn >= turn").isEmpty():
        return none.withColumn("circular", F.lit(False))
    refs, circles = stash(refs), none.select("conv_id", "key")
    late, made, n, ask = none, 0, 2, 2 * STEPS
    while True:
        new, step = late, _behind(refs)
        for _ in range(n):
            new = step(new)
        new = stash(new)
        still = new.join(late, ["conv_id", "key", "at"], "left_anti").isEmpty()
        unstash(late)
        late, made, n = new, made + n, min(STEPS, 2 * n)
        if still:
            break
        if made >= ask:  # a long chain, or a circle, on which places move without end
            members = _circles(refs, late)
            ask = 2 * made
            if not members.isEmpty():
                circles = stash(circles.union(members))
                refs = stash(refs.join(members, ["conv_id", "key"], "left_anti"))
                late, made, ask = none, 0, 2 * STEPS
    return late.select("conv_id", "key", "at", F.lit(False).alias("circular")).union(circles.select("conv_id", "key", F.lit(None).cast(none.schema["at"].dataType), F.lit(True)))


def link_tool_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, anchor_turn, depth, n_calls, n_linked, n_faults, json."""
    text = F.coalesce("text", F.lit(""))
    looks = F.ltrim(text).startswith("{")
    shape = F.when(looks, F.from_json(F.when(looks, text), _CALLS, {"mode": "PERMISSIVE"}))
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("text"), shape.alias("j")).withColumn("key", F.xxhash64("conv_id", "turn", "role", "text"))
    m = m.withColumn("is_result", F.coalesce(F.col("j.tool_call_id").isNotNull(), F.lit(False)))
    m = m.withColumn("calls", F.when(~F.col("is_result") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & (F.size("j.tool_calls") > 0), F.col("j.tool_calls")))
    m = m.withColumn("extra", F.when(F.col("calls").isNotNull(), _others(F.col("text"), "content", "tool_call_id", "tool_calls")).when(F.col("is_result"), _others(F.col("text"), "content", "tool_call_id")))
    # each call with the text of its own object, for the keys that have no field
    whole = F.from_json("text", "struct<tool_calls:array<string>>")["tool_calls"]
    calls = m.where("calls is not null").select("conv_id", "turn", "key", F.posexplode(F.arrays_zip("calls", whole.alias("whole"))).alias("place", "z"))
    calls = calls.select("conv_id", "turn", "key", "place", F.col("z.calls").alias("call"), _others(F.col("z.whole"), "id", "name", "arguments").alias("extra"))
    # arguments may be an object or, as some write it, a string that holds one; a variant keeps its keys in order
    calls = calls.select("conv_id", "turn", "key", "place", "call.*", "extra").distinct().withColumn("arguments", F.try_parse_json("arguments")).withColumn("extra", F.try_parse_json("extra"))
    # one row for each tool: its arguments by name
    once = tools.where("tool is not null").groupBy(F.col("tool").alias("name"), "argument").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    schemas = once.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("argument").isNotNull(), F.struct("argument", F.struct("type", "required"))))).alias("spec")
    )
    calls = calls.join(schemas, "name", "left")
    is_object = F.coalesce(F.schema_of_variant("arguments").startswith("OBJECT"), F.lit(False))
    given = F.from_json(F.when(is_object, F.to_json("arguments")).otherwise("{}"), "map<string,variant>")
    calls = calls.withColumns({"given": given, "is_object": is_object})
    points = lambda k: F.try_variant_get(F.element_at("given", k), "$.result_of", "string")
    wrong = F.filter(F.map_keys("given"), lambda k: ~(F.map_contains_key("spec", k) & points(k).isNotNull()) & ~F.coalesce(F.element_at("spec", k)["type"] == _type_of(F.element_at("given", k)), F.lit(False)) & ~F.coalesce((F.element_at("spec", k)["type"] == "number") & (_type_of(F.element_at("given", k)) == "integer"), F.lit(False)))
    missing = F.filter(F.map_keys("spec"), lambda k: F.element_at("spec", k)["required"] & ~F.map_contains_key("given", k))
    faults = F.when(F.col("spec").isNull(), F.array(F.lit("unknown tool"))).when(~F.col("is_object"), F.array(F.lit("arguments are no object"))).otherwise(
        F.array_sort(F.concat(F.transform(wrong, lambda k: F.concat(F.lit("bad argument "), k)), F.transform(missing, lambda k: F.concat(F.lit("missing argument "), k))))
    )
    absent = lambda c, fault: F.when(F.col(c).isNull(), F.array(F.lit(fault))).otherwise(F.array())
    faults = F.when(F.col("name").isNull(), F.array()).otherwise(faults)  # no schema to hold them against
    calls = calls.withColumn("faults", F.concat(faults, absent("id", "missing identifier"), absent("name", "missing name")))
    calls = calls.withColumn("refs", F.filter(F.transform(F.map_keys("given"), lambda k: F.struct(k.alias("argument"), points(k).alias("id"))), lambda r: r["id"].isNotNull()))
    # written once, as links, references and lines are made of it
    calls = stash(calls.select("conv_id", "turn", "key", "place", "id", "name", F.to_json("arguments").alias("arguments"), F.to_json("extra").alias("extra"), "faults", "refs"))
    # of calls with one identifier the earliest is the one that results belong to
    first = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place", "key")).alias("f"))
    results = m.where("is_result and conv_id is not null and turn is not null").select("conv_id", F.col("j.tool_call_id").alias("id"), "key").distinct()
    linked = results.join(first, ["conv_id", "id"]).select("conv_id", "key", F.col("f.turn").alias("call_turn"), F.col("f.key").alias("call_key"))
    answers = results.groupBy("conv_id", "id").agg(F.count("*").alias("n_results"))
    # references: what is wrong with them, and whether their messages have to wait
    refs = calls.where(F.size("refs") > 0).select("conv_id", "turn", "key", "place", F.explode("refs").alias("r")).select("conv_id", "turn", "key", "place", "r.argument", "r.id")
    refs = refs.join(first, ["conv_id", "id"], "left").join(answers, ["conv_id", "id"], "left")
    wrong_ref = F.when(F.col("f").isNull(), "unknown reference ").when(F.col("n_results").isNull(), "open reference ")
    late = _late(refs.where("n_results is not null").select("conv_id", "turn", "key", F.col("f.key").alias("of"), F.col("f.turn").alias("of_turn")))
    circular = late.where("circular").select("conv_id", "key", F.lit("circular reference").alias("circular"))
    bad_refs = refs.where(wrong_ref.isNotNull()).groupBy("conv_id", "key", "place").agg(F.array_sort(F.collect_list(F.concat(wrong_ref, "argument"))).alias("bad_refs"))
    calls = calls.join(first, ["conv_id", "id"], "left").join(answers, ["conv_id", "id"], "left").join(bad_refs, ["conv_id", "key", "place"], "left").join(circular, ["conv_id", "key"], "left")
    more = F.when(F.col("circular").isNotNull() & (F.size("refs") > 0), F.array("circular")).otherwise(F.array())
    calls = calls.withColumn("faults", F.concat("faults", F.coalesce("bad_refs", F.array().cast("array<string>")), more))
    mine = (F.col("f.turn") == F.col("turn")) & (F.col("f.place") == F.col("place")) & (F.col("f.key") == F.col("key"))
    state = F.when(~mine, "duplicate").when(F.col("n_results") > 0, "answered").otherwise("open")
    line = F.struct(F.try_parse_json("arguments").alias("arguments"), F.try_parse_json("extra").alias("extra"), F.col("faults"), F.col("id"), F.col("name"), state.alias("state"))
    per_message = calls.groupBy("conv_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("place", F.to_json(line).alias("line")))).alias("lines"),
        F.sum(F.when(mine & (F.col("n_results") > 0), 1).otherwise(0)).alias("answered"), F.sum(F.size("faults")).alias("faulty"),
    )
    waits = late.where("not circular").select("conv_id", F.col("key").alias("node"), "at")
    node = F.coalesce("call_key", "key")  # a result goes where its call goes
    out = m.join(per_message, ["conv_id", "key"], "left").join(linked, ["conv_id", "key"], "left").withColumn("node", node).join(waits, ["conv_id", "node"], "left")
    n_calls = F.coalesce(F.size("lines"), F.lit(0))
    lines = F.array_join(F.transform("lines", lambda x: x["line"]), ",")
    content = F.when(F.col("calls").isNotNull() | F.col("is_result"), F.coalesce("j.content", F.lit(""))).otherwise(F.col("text"))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text_json = lambda c: F.to_json(F.struct(c.alias("v")))  # noqa: E731  {"v":...}
    unwrap = lambda c: F.substr(text_json(c), F.lit(6), F.length(text_json(c)) - 6)
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    parts = [
        F.when(n_calls > 0, field("calls", F.concat(F.lit("["), lines, F.lit("]")))),
        field("content", unwrap(content)),
        field("conv_id", number(F.col("conv_id"))),
        F.when(F.col("extra").isNotNull(), field("extra", F.col("extra"))),
        F.when(F.col("is_result"), field("result_of", unwrap(F.coalesce("j.tool_call_id", F.lit(""))))),
        F.when(F.col("is_result"), field("result_state", F.when(F.col("call_turn").isNotNull(), F.lit('"linked"')).otherwise(F.lit('"orphan"')))),
        field("role", unwrap(F.col("role"))),
        field("turn", number(F.col("turn"))),
    ]
    return out.select(
        "conv_id", "turn", "role", F.coalesce("at.turn", "call_turn", "turn").alias("anchor_turn"), (F.coalesce("at.depth", F.lit(0)) + F.when(F.col("call_turn").isNotNull(), 1).otherwise(0)).alias("depth"),
        n_calls.cast("long").alias("n_calls"), F.coalesce("answered", F.when(F.col("call_turn").isNotNull(), 1).otherwise(0)).cast("long").alias("n_linked"), F.coalesce("faulty", F.lit(0)).cast("long").alias("n_faults"),
        F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"),
    )
