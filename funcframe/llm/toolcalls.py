"""Tool-call linking with DataFrame functions alone: join by identifier, order by dependency, validate, write canonical JSON.

Defined cases. Null conversation or call ids never link: such a call has no result, such a result is an orphan. Of calls,
or results, with one id in a conversation, the one with the lowest sequence number counts (then the least text) and
``n_calls`` and ``n_results`` tell how many there were; each different further one is a row of its own with the status
``repeated``, where they tell how many rows it stands for. Arguments that are no JSON object are invalid, so are JSON texts
with a repeated key. A dependency on an unknown call is not waited for. Calls in or behind a cycle have a null level.
Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe.llm.common import materialise, table

#: For each tool its fields: (type as in ``schema_of_variant``, required, least and greatest length or value).
Schema = dict[str, dict[str, tuple[str, bool, int | None, int | None]]]
SCHEMAS: Schema = {
    "reply": {"prompt": ("STRING", True, 1, None), "turn": ("BIGINT", True, 0, None), "context": ("STRING", False, 1, None)},
    "set_system": {"prompt": ("STRING", True, 1, None), "turn": ("BIGINT", True, 0, 0)},
}
KEY = ["conv_id", "call_id"]
CALL, RESULT = ["seq", "name", "arguments", "depends_on"], ["seq", "content"]
#: Conversations with so many characters of identifiers and dependencies (some MB in memory) go to one task as an array.
INLINE = 1 << 19
#: Ids of at most so many conversations (16 MB) are sent to all executors; more are joined by a shuffle.
SENT_IDS = 1_000_000
#: Tables of settled calls that are read side by side before they are written as one.
KEPT_APART = 16


def canonical(text: Column) -> Column:
    """JSON with keys in order and no blanks (objects of a variant keep their keys sorted); null where it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def _quoted(c: Column) -> Column:
    inner = F.to_json(F.array(c.cast("string")), {"ignoreNullFields": "false"})
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def problems(name: Column, arguments: Column, schemas: Schema) -> Column:
    """What is wrong with the arguments: sorted messages, an empty array if nothing is."""
    v = F.try_parse_json(arguments)
    object_ = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    checks = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        own = [F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(F.lit("unexpected "), k))]
        for field, (kind, required, low, high) in fields.items():
            path = f"$.{field}"
            have = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
            tests = [F.when(~F.array_contains(keys, field), F.lit(f"missing {field}"))] if required else []
            tests.append(F.when(F.array_contains(keys, field) & ~F.coalesce(have == kind, F.lit(False)), F.lit(f"type of {field}")))
            size = F.length(F.try_variant_get(v, path, "string")) if kind == "STRING" else F.try_variant_get(v, path, "double")
            for bound, bad in ((low, lambda b, s=size: s < b), (high, lambda b, s=size: s > b)):
                if bound is not None:
                    tests.append(F.when((have == kind) & bad(bound), F.lit(f"range of {field}")))
            own.append(F.array_compact(F.array(*tests)))
        checks = F.when(name == tool, F.array_sort(F.concat(*own))).otherwise(checks)
    return F.when(object_, checks).otherwise(F.array(F.lit("no object")))


def _in_order(nodes: DataFrame) -> DataFrame:
    """KEY, ``depends_on``, ``level`` and ``apart``: each conversation in one pass over its calls in the order of ``seq``.

    ``apart`` tells that a call of the conversation depends on itself or a later one; its levels do not count then.
    """
    order = F.array_sort(F.collect_list(F.struct("seq", "call_id", "depends_on")))
    listed = nodes.groupBy("conv_id").agg(order.alias("calls"))

    def step(done: Column, call: Column) -> Column:
        at = F.transform(F.coalesce(call["depends_on"], F.array().cast("array<string>")), lambda on: F.array_position(done["ids"], on).cast("int"))
        known = F.filter(at, lambda k: k > 0)
        below = F.array_max(F.transform(known, lambda k: F.get(done["levels"], k - 1)))
        late = F.exists(known, lambda k: k > F.size(done["levels"]))
        return F.struct(done["ids"].alias("ids"), F.array_append(done["levels"], F.coalesce(below + 1, F.lit(0))).alias("levels"), (done["apart"] | late).alias("apart"))

    start = F.struct(F.transform("calls", lambda c: c["call_id"]).alias("ids"), F.array().cast("array<int>").alias("levels"), F.lit(False).alias("apart"))
    passed = listed.select("conv_id", "calls", F.aggregate("calls", start, step).alias("end"))
    each = passed.select("conv_id", F.col("end.apart").alias("apart"), F.explode(F.arrays_zip("calls", F.col("end.levels").alias("levels"))).alias("one"))
    return each.select("conv_id", "one.calls.call_id", "one.calls.depends_on", F.col("one.levels").alias("level"), "apart")


def levels(calls: DataFrame, inline: int = INLINE) -> DataFrame:
    """KEY and ``level`` of calls (KEY, seq, depends_on): 0 without dependencies, else one more than the highest of them;
    null on and behind cycles.

    Conversations whose identifiers and dependencies take at most ``inline`` characters, and whose calls depend on earlier
    ones alone, take one pass over an array. Calls of any others are settled by joins; both ways give the same levels.
    """
    nodes = materialise(calls.select(*KEY, "seq", "depends_on"), "calls")
    weight = F.sum(F.length(F.to_json(F.struct("call_id", "depends_on"))))
    long = materialise(nodes.groupBy("conv_id").agg(weight.alias("weight")).where(F.col("weight") > inline).select("conv_id"), "long")
    some = F.broadcast(long) if long.count() <= SENT_IDS else long
    short = materialise(_in_order(nodes.join(some, "conv_id", "left_anti")), "short")
    rest = nodes.join(some, "conv_id", "left_semi").select(*KEY, "depends_on")
    rest = materialise(rest.unionByName(short.where("apart").select(*KEY, "depends_on")), "rest")
    found = short.where("NOT apart").select(*KEY, "level")
    return found if rest.isEmpty() else found.unionByName(_by_joins(rest))


def _by_joins(nodes: DataFrame) -> DataFrame:
    """KEY and ``level`` of materialised calls (KEY, depends_on).

    Chains of calls with one dependency each are followed by doubling, in as many rounds as the logarithm of the longest.
    What is left are calls with several dependencies; each of their rounds settles those that wait for none of them, and
    reads only what the round before has settled. Rows are dealt by conversation and call together, so that one long
    conversation is no single task.
    """
    known = nodes.select("conv_id", F.col("call_id").alias("on"))
    edges = nodes.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("on")).where("on IS NOT NULL")
    edges = materialise(edges.join(known, ["conv_id", "on"], "left_semi"), "edges")
    count = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("deps"), F.min("on").alias("on"))
    # each call with the one that it hangs on, and how far that is; a call with none or several hangs on itself
    one = F.coalesce(F.col("deps") == 1, F.lit(False))
    hung = nodes.select(*KEY).join(count, KEY, "left").select(*KEY, F.coalesce("deps", F.lit(0)).alias("deps"), F.when(one, F.col("on")).otherwise(F.col("call_id")).alias("up"), one.cast("int").alias("far"), one.alias("more"))
    hung, left = materialise(hung, "hung"), None
    while True:
        n = hung.where("more").count()
        if n in (0, left):  # none, or only those on and behind cycles
            break
        left = n
        above = hung.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("more").alias("more2"))
        hung = hung.join(above, ["conv_id", "up"]).select(*KEY, "deps", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("more") & F.col("more2")).alias("more"))
        hung = materialise(hung, "hung")
    hung = hung.where("NOT more")
    last = hung.where("deps = 0").select("conv_id", F.col("call_id").alias("up"), F.lit(0).alias("base"))
    settled = [last]
    waiting = hung.where("deps > 1").select(*KEY)
    if not waiting.isEmpty():
        via = hung.select("conv_id", F.col("call_id").alias("on"), "up", "far")
        several = edges.join(waiting, KEY, "left_semi").join(via, ["conv_id", "on"], "left").select(*KEY, "up", "far", F.lit(None).cast("int").alias("over"))
        several = materialise(several, "several")
        while True:
            told = several.join(last, ["conv_id", "up"], "left").select(*KEY, "up", "far", F.coalesce("over", F.col("far") + F.col("base") + 1).alias("over"))
            told = materialise(told, "told")
            based = told.groupBy(*KEY).agg(F.max("over").alias("base"), F.max(F.col("over").isNull()).alias("waits"))
            last = materialise(based.where("NOT waits").select("conv_id", F.col("call_id").alias("up"), "base"), "done")
            if last.isEmpty():
                break
            settled.append(last)
            if len(settled) > KEPT_APART:
                settled = [materialise(reduce(DataFrame.unionByName, settled), "settled")]
            several = materialise(told.join(last.select("conv_id", F.col("up").alias("call_id")), KEY, "left_anti"), "several")
    placed = hung.join(reduce(DataFrame.unionByName, settled), ["conv_id", "up"]).select(*KEY, (F.col("far") + F.col("base")).alias("level"))
    return nodes.select(*KEY).join(placed, KEY, "left")


def _repeated(rows: DataFrame, fields: list[str]) -> DataFrame:
    """KEY, ``row`` and ``n``: what rows of one identifier there are besides the first of them, and how often each."""
    many = materialise(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY), "many")
    if many.isEmpty():
        return rows.limit(0).select(*KEY, F.struct(*fields).alias("row"), F.lit(0).cast("long").alias("n"))
    each = rows.join(many, KEY, "left_semi").select(*KEY, F.struct(*fields).alias("row")).groupBy(*KEY, "row").agg(F.count(F.lit(1)).alias("n"))
    each = materialise(each, "repeated")
    first = each.groupBy(*KEY).agg(F.min("row").alias("first"))
    return each.join(first, KEY).select(*KEY, "row", (F.col("n") - F.col("row").eqNullSafe(F.col("first")).cast("int")).alias("n")).where("n > 0")


def link(calls: DataFrame, results: DataFrame, schemas: Schema = SCHEMAS) -> DataFrame:
    """One row for each call (conv_id, call_id, seq, name, arguments, depends_on) and each result (conv_id, call_id, seq,
    content) without a call: conv_id, call_id, seq, level, status, json, n_calls, n_results.

    In a conversation, ``level``, ``seq`` and ``call_id`` in this order put every call behind those that it depends on.
    """
    named = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    c = calls.where(named).groupBy(*KEY).agg(F.min(F.struct(*CALL)).alias("call"), F.count(F.lit(1)).alias("n_calls"))
    r = results.where(named).groupBy(*KEY).agg(F.min(F.struct(*RESULT)).alias("result"), F.count(F.lit(1)).alias("n_results"))
    c = c.join(levels(c.select(*KEY, "call.seq", "call.depends_on")), KEY)
    none, zero, no = F.lit(None), F.lit(0), F.lit(False).alias("again")
    loose_calls = calls.where(f"NOT ({named})").select(*KEY, F.struct(*CALL).alias("call"), F.lit(1).alias("n_calls"), zero.alias("level"), none.alias("result"), zero.alias("n_results"), no)
    loose_results = results.where(f"NOT ({named})").select(*KEY, none.alias("call"), zero.alias("n_calls"), none.cast("int").alias("level"), F.struct(*RESULT).alias("result"), F.lit(1).alias("n_results"), no)
    more_calls = _repeated(calls.where(named), CALL).select(*KEY, F.col("row").alias("call"), F.col("n").alias("n_calls"), none.cast("int").alias("level"), none.alias("result"), zero.alias("n_results"), F.lit(True).alias("again"))
    more_results = _repeated(results.where(named), RESULT).select(*KEY, none.alias("call"), zero.alias("n_calls"), none.cast("int").alias("level"), F.col("row").alias("result"), F.col("n").alias("n_results"), F.lit(True).alias("again"))
    both = c.join(r, KEY, "full_outer").withColumn("again", no)
    for more in (loose_calls, loose_results, more_calls, more_results):
        both = both.unionByName(more)
    wrong = problems(F.col("call.name"), F.col("call.arguments"), schemas)
    both = both.select(*KEY, "call", "result", "level", "n_calls", "n_results", "again", F.when(F.col("call").isNotNull(), wrong).alias("errors"))
    status = (
        F.when(F.col("again"), "repeated")
        .when(F.col("call").isNull(), "orphan result")
        .when(F.size("errors") > 0, "invalid arguments")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("result").isNull(), "no result")
        .otherwise("linked")
    )
    null = F.lit("null")
    errors = F.to_json(F.coalesce("errors", F.array().cast("array<string>")))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("call.arguments")), null),
        F.lit(',"errors":'), errors,
        F.lit(',"id":'), _quoted(F.col("call_id")),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), null),
        F.lit(',"name":'), _quoted(F.col("call.name")),
        F.lit(',"result":'), _quoted(F.col("result.content")),
        F.lit("}"),
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select(*KEY, F.coalesce("call.seq", "result.seq").alias("seq"), F.col("level").cast("int").alias("level"), status.alias("status"), json.alias("json"), count("n_calls"), count("n_results"))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: a user's turn calls ``reply`` and depends on the call two turns before,
    the assistant's next turn is its result; a system turn calls ``set_system``, which has none. Other roles are results."""
    role, turn = F.col("role"), F.col("turn")
    ident = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    asks = F.coalesce(role.isin("user", "system"), F.lit(False))
    chained = (role == "user") & (turn >= 2)
    context = F.when(chained, ident(turn - 2))
    calls = turns.where(asks).select(
        "conv_id",
        F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), ident(turn)).alias("call_id"),
        turn.alias("seq"),
        F.when(role == "user", "reply").otherwise("set_system").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn"), context.alias("context"))).alias("arguments"),
        F.array_compact(F.array(context)).alias("depends_on"),
    )
    results = turns.where(~asks).select("conv_id", F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), ident(turn - 1)).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    return calls, results


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*from_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP4_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, turn AS seq, CASE role WHEN 'user' THEN 'reply' ELSE 'set_system' END AS name, text AS prompt,
         CASE WHEN role = 'user' AND turn >= 2 THEN conv_id || ':' || (turn - 2) END AS context
  FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn AS seq, text AS content FROM conversations WHERE role NOT IN ('user', 'system')),
v AS (
  SELECT call_id, 0 AS level FROM c WHERE context IS NULL OR context NOT IN (SELECT call_id FROM c)
  UNION ALL SELECT c.call_id, v.level + 1 FROM c JOIN v ON c.context = v.call_id),
e AS (
  SELECT c.*, v.level, list_sort(list_filter([
      CASE WHEN prompt IS NULL THEN 'missing prompt' WHEN prompt = '' THEN 'range of prompt' END,
      CASE WHEN name = 'set_system' AND seq > 0 THEN 'range of turn' END], lambda x: x IS NOT NULL)) AS errors
  FROM c JOIN v USING (call_id))
SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, coalesce(e.call_id, r.call_id) AS call_id, coalesce(e.seq, r.seq) AS seq, CAST(level AS INTEGER) AS level,
       CASE WHEN e.call_id IS NULL THEN 'orphan result' WHEN len(errors) > 0 THEN 'invalid arguments' WHEN r.call_id IS NULL THEN 'no result' ELSE 'linked' END AS status,
       '{"arguments":' || CASE WHEN e.call_id IS NULL THEN 'null' ELSE '{' || coalesce('"context":' || CAST(to_json(context) AS VARCHAR) || ',', '') || coalesce('"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',', '') || '"turn":' || e.seq || '}' END
       || ',"errors":' || CAST(to_json(coalesce(errors, [])) AS VARCHAR) || ',"id":' || CAST(to_json(coalesce(e.call_id, r.call_id)) AS VARCHAR)
       || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null')
       || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json,
       CAST(CASE WHEN e.call_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_calls, CAST(CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results
FROM e FULL OUTER JOIN r ON e.call_id = r.call_id
"""
