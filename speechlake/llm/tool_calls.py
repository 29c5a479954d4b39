"""Chat formatting: tool calls linked to their results, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions.ranking import running_sum
from speechlake.sources.shared import written

#: For each tool the type of each argument, or the strings that it may be, and whether it must be there.
Schemas = dict[str, dict[str, tuple[str | tuple[str, ...], bool]]]
#: What schema_of_variant() says of a value of each type.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "array": "ARRAY.*", "object": "OBJECT.*"}


def arguments_valid(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments, a JSON object as text, fit the tool's schema: known names, all that must be there, each of its type.

    Types are string, integer, number, boolean, array and object; a tuple of strings is an enumeration. False for an unknown tool, for text that is no JSON object and for null.
    """
    parsed = F.try_parse_json(arguments)
    names = F.json_object_keys(arguments)
    out = F.lit(False)
    for name, fields in schemas.items():
        ok = F.size(F.array_except(names, F.array(*[F.lit(f) for f in fields]).cast("array<string>"))) == 0
        for field, (kind, needed) in fields.items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            right = F.schema_of_variant(value).rlike(f"^{TYPES[kind if isinstance(kind, str) else 'string']}$")
            if not isinstance(kind, str):
                right = right & F.try_variant_get(parsed, f"$.{field}", "string").isin(*kind)
            ok = ok & F.coalesce(right, F.lit(not needed))
        out = F.when(tool == name, ok).otherwise(out)
    return F.coalesce(F.when(parsed.isNotNull() & names.isNotNull(), out), F.lit(False))


def _same(a: DataFrame, b: DataFrame, conv: str, call: str, other: str = "call_id") -> Column:
    return a["conv_id"].eqNullSafe(b[conv]) & (a[other] == b[call])


def _settle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (conv_id, call_id, key, depth) with the largest (key, depth + steps) over edges (conv_id, call_id, dep, steps), and stuck.

    In a round each edge to a call without edges goes, and leaves that call's place with the caller; each to a call with one
    edge is led on to where that one ends, so chains halve. Where no edge ends at a call without edges, all calls that
    still have some wait for themselves or for such.
    """
    nodes, edges = written(nodes, "calls"), written(edges, "waits")
    while True:
        out = edges.groupBy(F.col("conv_id").alias("_oc"), F.col("call_id").alias("_od")).agg(F.count(F.lit(1)).alias("_n"), F.min("dep").alias("_to"), F.min("steps").alias("_more"))
        state = nodes.join(out, _same(nodes, out, "_oc", "_od"), "left").select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_d"), "key", "depth", F.coalesce("_n", F.lit(0)).alias("_n"), "_to", "_more")
        met = edges.join(state, _same(edges, state, "_c", "_d", "dep"))
        led = (F.col("_n") == 1) & (F.col("_to") != F.col("dep"))
        met = met.select("conv_id", "call_id", "dep", "steps", "_n", F.when(led, F.col("_to")).alias("_to"), "_more", F.when(led | (F.col("_n") == 0), F.struct("key", (F.col("depth") + F.col("steps")).alias("depth"))).alias("_w"))
        met = written(met, "places")
        if met.where("_n = 0").isEmpty():
            waiting = edges.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_d")).distinct().withColumn("_stuck", F.lit(True))
            return nodes.join(waiting, _same(nodes, waiting, "_c", "_d"), "left").select("conv_id", "call_id", "key", "depth", F.coalesce("_stuck", F.lit(False)).alias("stuck"))
        most = met.groupBy(F.col("conv_id").alias("_c"), F.col("call_id").alias("_d")).agg(F.max("_w").alias("_w"))
        place = F.greatest(F.struct("key", "depth"), F.col("_w"))
        nodes = written(nodes.join(most, _same(nodes, most, "_c", "_d"), "left").select("conv_id", "call_id", place["key"].alias("key"), place["depth"].alias("depth")), "calls")
        steps = F.when(F.col("_to").isNull(), F.col("steps")).otherwise(F.least(F.col("steps") + F.col("_more"), F.lit(1 << 40)))  # no longer but in a circle
        edges = met.where("_n > 0").groupBy("conv_id", "call_id", F.coalesce("_to", "dep").alias("dep")).agg(F.max(steps).alias("steps"))
        edges = written(edges, "waits")


def call_places(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, key, depth, stuck) of calls: conv_id, call_id, turn, depends (the ids of calls whose results a call waits for).

    key is the turn at which all that a call waits for is there, its own or a later one, and depth how many calls
    that wait for that turn come before it. Both are the largest of (turn, 0) and (key, depth + 1) over what it
    waits for. Calls in order need no join: a conversation's calls before the first that waits for its own turn or a later one,
    and those behind the last turn waited for so, stand by their turn. The others are placed in rounds of joins
    (see _settle): the logarithm of the longest chain of calls that wait for one call each, and one for each
    further call of a chain of calls that wait for several. A call that waits for itself, by whatever way, is
    stuck, as is one that waits for such a call; both stand by their turn. All circles are known in the same round. Only in their
    conversations the calls behind the last turn are placed so as well, as they may wait for one. Ids that are no call of
    the conversation are not waited for; a null turn comes last.
    """
    known = calls.select("conv_id", "call_id", F.coalesce("turn", F.lit(2**63 - 1)).alias("turn"), F.coalesce("depends", F.array().cast("array<string>")).alias("depends"))
    known = written(known.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"), F.array_distinct(F.flatten(F.collect_list("depends"))).alias("depends")), "calls")
    edges = known.select("conv_id", "call_id", "turn", F.explode("depends").alias("dep"))
    there = known.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_d"), F.col("turn").alias("dep_turn"))
    edges = written(edges.join(there, _same(edges, there, "_c", "_d", "dep")).select("conv_id", "call_id", "dep", "turn", "dep_turn", F.lit(1).cast("long").alias("steps")), "waits")
    late = edges.where("dep_turn >= turn").groupBy(F.col("conv_id").alias("_c")).agg(F.min("turn").alias("_first"), F.max("dep_turn").alias("_last"))
    late = written(late, "late")

    def within(rows: DataFrame, bounds: DataFrame) -> DataFrame:
        return rows.join(bounds, rows["conv_id"].eqNullSafe(bounds["_c"])).where("turn >= _first and turn <= _last").drop("_c", "_first", "_last")

    def place(bounds: DataFrame) -> DataFrame:
        nodes = within(known, bounds).select("conv_id", "call_id", F.col("turn").alias("key"), F.lit(0).cast("long").alias("depth"))
        waits = within(edges, bounds).join(bounds, F.col("conv_id").eqNullSafe(F.col("_c"))).where("dep_turn >= _first").select("conv_id", "call_id", "dep", "steps")
        return written(_settle(nodes, waits), "placed")

    placed = place(late)
    ends = known.groupBy(F.col("conv_id").alias("_e")).agg(F.max("turn").alias("_end"))
    stuck = placed.where("stuck").select(F.col("conv_id").alias("_s")).distinct()
    again = late.join(stuck, F.col("_c").eqNullSafe(F.col("_s"))).join(ends, F.col("_c").eqNullSafe(F.col("_e"))).where("_end > _last").select("_c", "_first", F.col("_end").alias("_last"))
    again = written(again, "again")
    if not again.isEmpty():
        placed = placed.join(again, placed["conv_id"].eqNullSafe(again["_c"]), "left_anti").unionByName(place(again))
    found = placed.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_d"), "key", "depth", "stuck")
    free = ~F.coalesce("stuck", F.lit(False))
    out = known.join(found, _same(known, found, "_c", "_d"), "left")
    return out.select("conv_id", "call_id", F.coalesce(F.when(free, F.col("key")), "turn").alias("key"), F.coalesce(F.when(free, F.col("depth")), F.lit(0)).cast("long").alias("depth"), (~free).alias("stuck"))


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """Link calls and results, order each conversation topologically and serialise each message.

    messages: conv_id, turn, role, text, call_id, tool, arguments (JSON text) and, if there are such, depends: the ids
    of calls of the conversation whose results a call needs. A call is a row with a
    tool; a result is a row of role "tool". They meet by (conv_id, call_id) in a hash join; where an id
    has several calls the first turn counts. In a conversation a result stands right after its call,
    whatever its turn, and a call behind the results that it needs (see call_places); all other rows stand by their
    turn. Returns conv_id, turn, position (from 0), role, call_id, call_turn (of a linked result), status and json.

    status: call (arguments fit the schema), bad_call, stuck (a call that waits for itself), result, orphan (a
    result without a call, which becomes a user message) or message. json is canonical: keys sorted, no white space, absent values
    left out; arguments that are no JSON are left out. A null conv_id is a conversation, null turns come
    last and equal rows take neighbouring positions. Places come from buckets of 1024 turns, so one long
    conversation is not one group. Other columns are left behind.
    """
    depends = F.col("depends") if "depends" in messages.columns else F.lit(None).cast("array<string>")
    messages = messages.select("conv_id", "turn", "role", "text", "call_id", "tool", "arguments", depends.alias("depends"))
    calls = messages.where(F.col("tool").isNotNull() & F.col("call_id").isNotNull())
    places = call_places(calls).select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "key", "depth", "stuck")
    calls = calls.groupBy(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i")).agg(F.min("turn").alias("_turn"))
    calls = calls.join(places, calls["_c"].eqNullSafe(places["_conv"]) & (calls["_i"] == places["_call"])).select("_conv", "_call", "_turn", "key", "depth", "stuck", F.lit(True).alias("_found"))
    is_call = F.col("tool").isNotNull()
    is_result = (F.col("role") == "tool") & ~is_call
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call")) & (is_result | is_call)
    rows = messages.join(calls.hint("shuffle_hash"), same, "left").drop("depends")
    linked = F.coalesce("_found", F.lit(False)) & ~is_call
    status = (
        F.when(is_call & F.coalesce("stuck", F.lit(False)), "stuck").when(is_call & arguments_valid(F.col("tool"), F.col("arguments"), schemas), "call").when(is_call, "bad_call")
        .when(linked, "result").when(F.coalesce(is_result, F.lit(False)), "orphan").otherwise("message")
    )
    rows = rows.withColumns({"status": status, "call_turn": F.when(linked, F.col("_turn"))})
    rows = rows.withColumn("role", F.when(F.col("status") == "orphan", "user").otherwise(F.col("role")))
    rows = rows.withColumn("call_id", F.when(F.col("status").isin("call", "bad_call", "stuck", "result"), F.col("call_id")))
    call = F.when(is_call, F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name")))
    json = F.to_json(F.struct(call.alias("call"), F.col("text").alias("content"), F.when(linked, F.col("call_id")).alias("in_reply_to"), "role"))
    last = F.lit(2**63 - 1)
    own = F.coalesce("turn", last)
    again = is_call & (own > F.col("key"))  # a call whose id has come before
    place, depth = F.when(again, own).otherwise(F.coalesce("key", own)), F.when(again, 0).otherwise(F.coalesce("depth", F.lit(0)))
    rows = rows.select("conv_id", "turn", "role", "call_id", "call_turn", "status", json.alias("json"), place.alias("_place"), depth.alias("_depth"))
    place = F.col("_place")
    order = [place, F.col("_depth"), (F.col("status") == "result").cast("int"), F.coalesce("turn", last), F.col("json")]
    out = running_sum(rows, ["conv_id"], F.floor(place / 1024), order, F.lit(1), "position")
    return out.select("conv_id", "turn", "position", "role", "call_id", "call_turn", "status", "json")
