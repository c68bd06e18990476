"""Chat formatting: tool calls linked with their results, ordered, checked and written as canonical JSON."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.tables import dropped, kept

# Tools as name -> argument -> (type, required). Types are those of JSON; an integer is any number without a fraction.
Schemas = dict[str, dict[str, tuple[str, bool]]]
AT_ONCE = 1000  # dependencies of a conversation that is ordered by one task; larger ones are ordered by joins
_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
_REFERENCE = r'"\$ref:([^"\\]+)"'
_ESCAPE, _LONE = re.compile(r"\\(?:u([0-9a-f]{4})|.)"), re.compile("[\ud800-\udfff]")


def calls_of(messages: DataFrame) -> DataFrame:
    """A row for each call in assistant messages that hold ``{"tool_calls": [{id, name, arguments}]}``, null ids included."""
    said = messages.where("role = 'assistant' AND text LIKE '%tool_calls%'")
    parsed = said.select("conv_id", "turn", F.posexplode(F.from_json("text", _CALLS)["tool_calls"]).alias("place", "call"))
    return parsed.select("conv_id", "turn", "place", F.col("call.id").alias("call_id"), "call.name", "call.arguments")


def results_of(messages: DataFrame) -> DataFrame:
    """A row for each tool message that holds ``{"tool_call_id", "content"}``; without an id there must be a content."""
    parsed = messages.where("role = 'tool'").select(
        "conv_id", F.col("turn").alias("result_turn"), F.from_json("text", _RESULT).alias("result")
    )
    rows = parsed.select("conv_id", "result_turn", F.col("result.tool_call_id").alias("call_id"), "result.content")
    return rows.where("call_id IS NOT NULL OR content IS NOT NULL")


def _number(value: Decimal) -> str:
    """The exact value in one form: ``5``, ``5.0`` and ``5e0`` are ``5``; an exponent beyond 21 digits or six leading zeros."""
    if not value:
        return "0"
    sign, digits, exponent = value.as_tuple()
    whole = "".join(map(str, digits)).lstrip("0")
    text = whole.rstrip("0")
    point = len(whole) + exponent  # the value is 0.text times ten to the power of point
    if -6 < point <= 21:
        if point <= 0:
            text = "0." + "0" * -point + text
        elif len(text) <= point:
            text += "0" * (point - len(text))
        else:
            text = f"{text[:point]}.{text[point:]}"
    else:
        fraction = f".{text[1:]}" if len(text) > 1 else ""
        text = f"{text[0]}{fraction}e{point - 1:+d}"
    return "-" * sign + text


def _string(value: str) -> str:
    """A JSON string as Spark writes it: only what must be escaped is, in upper case; halves of pairs are escaped too."""
    text = _ESCAPE.sub(lambda m: f"\\u{m[1].upper()}" if m[1] else m[0], json.dumps(value, ensure_ascii=False))
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04X}", text)


def canonical(value: object) -> str:
    """JSON without blanks, keys in order of their code points, numbers by their exact value."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_string(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, Decimal):
        return _number(value)
    return _string(value) if isinstance(value, str) else json.dumps(value)


def _pairs(pairs: list[tuple[str, object]]) -> dict[str, object]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _is_kind(value: object, kind: str) -> bool:
    if kind == "integer":
        exponent = value.as_tuple().exponent if isinstance(value, Decimal) else 0
        return isinstance(value, Decimal) and (exponent >= 0 or not any(value.as_tuple().digits[exponent:]))
    return isinstance(value, {"string": str, "number": Decimal, "boolean": bool, "array": list, "object": dict}[kind])


def checked(name: str | None, arguments: str | None, schemas: Schemas) -> tuple[str, list[str]]:
    """The arguments of a call as canonical JSON and what is wrong with them.

    Text that is no JSON, repeats a key or nests too deep to be read is kept whole, as a JSON string.
    """
    if arguments is None:
        return "null", ["arguments are no object"]
    try:
        value = json.loads(
            arguments, object_pairs_hook=_pairs, parse_float=Decimal, parse_int=Decimal, parse_constant=_constant
        )
        text = canonical(value)
    except (ValueError, ArithmeticError, RecursionError):
        return _string(arguments), ["arguments are no object"]
    if not isinstance(value, dict):
        return text, ["arguments are no object"]
    if name not in schemas:
        return text, ["unknown tool"]
    problems = []
    for argument, (kind, required) in sorted(schemas[name].items()):
        given = value.get(argument)
        if given is None:
            problems += [f"missing {argument}"] * required
        elif not _is_kind(given, kind):
            problems.append(f"{argument} is no {kind}")
    return text, problems + [f"unknown {_string(a)[1:-1]}" for a in sorted(value.keys() - schemas[name].keys())]


def _checks(schemas: Schemas) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("text string, problems array<string>")
    def check(names: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        rows = [checked(n, a, schemas) for n, a in zip(names, arguments, strict=True)]
        return pd.DataFrame(rows, columns=["text", "problems"])

    return check


def _depths_of(needs: dict[str, set[str]]) -> dict[str, int]:
    """Depths of the calls off cycles, in rounds over the calls whose needs are settled."""
    users, open_needs, done = defaultdict(list), {}, {}
    for call, needed in needs.items():
        open_needs[call] = len(needed)
        for n in needed:
            users[n].append(call)
    ready, depth = [c for c in users if c not in needs], 0
    while ready:
        done.update(dict.fromkeys(ready, depth))
        later = []
        for call in ready:
            for user in users[call]:
                open_needs[user] -= 1
                if not open_needs[user]:
                    later.append(user)
        ready, depth = later, depth + 1
    return done


def _ordered(needs: Column) -> Column:
    """Depths of the calls with needs, for the list of a conversation's dependencies."""

    def depths_of(pairs: list[dict[str, str]]) -> list[dict[str, object]]:
        found = defaultdict(set)
        for pair in pairs:
            found[pair["call_id"]].add(pair["needed"])
        return [{"call_id": call, "depth": depth} for call, depth in _depths_of(found).items() if call in found]

    @F.pandas_udf("array<struct<call_id:string,depth:long>>")
    def all_depths(conversations: pd.Series) -> pd.Series:
        return conversations.map(depths_of)

    return all_depths(needs)


def _joined_depths(edges: DataFrame) -> DataFrame:
    """Depths by joins, for conversations of any size.

    Chains of calls with a single need are first shortened to one link by path doubling, in as many rounds as the
    length of the longest one has binary digits. Only the calls with several needs are then settled one
    depth a round.
    """
    key = ["conv_id", "call_id"]
    counted = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("needed").alias("up"))
    single = kept(counted.where("n = 1").select(*key, "up", F.lit(1).cast("long").alias("steps")), "links")
    several = kept(counted.where("n > 1").select(*key, "n"), "open")
    for _ in range(single.count().bit_length()):
        above = single.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        longer = single.join(above, ["conv_id", "up"], "left").select(
            *key, F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("next").isNotNull().alias("moved"),
        )
        before, single = single, kept(longer, "links")
        dropped(before)
        if not single.where("moved").head(1):
            break
    # A link that still ends in a call with one need is on a cycle or behind one.
    ends = single.join(single.select("conv_id", F.col("call_id").alias("up")), ["conv_id", "up"], "left_anti")
    ends = kept(ends.select(*key, "up", "steps"), "ends")
    needs = edges.join(several.select(*key), key)
    to_single = ends.select("conv_id", F.col("call_id").alias("needed"), "up", "steps")
    looped = single.join(ends.select(*key), key, "left_anti").select("conv_id", F.col("call_id").alias("needed"))
    needs = needs.join(looped, ["conv_id", "needed"], "left_anti").join(to_single, ["conv_id", "needed"], "left")
    needs = kept(
        needs.select(*key, F.coalesce("up", "needed").alias("up"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "needs"
    )
    roots = needs.select("conv_id", "up").union(ends.select("conv_id", "up")).distinct()
    roots = roots.join(several.select("conv_id", F.col("call_id").alias("up")), ["conv_id", "up"], "left_anti")
    settled = done = kept(roots.select("conv_id", F.col("up").alias("call_id"), F.lit(0).cast("long").alias("depth")), "depth")
    met = needs.limit(0).select(*key, F.lit(0).cast("long").alias("met"), F.lit(0).cast("long").alias("depth"))
    while settled.head(1):
        reached = needs.join(settled.select("conv_id", F.col("call_id").alias("up"), "depth"), ["conv_id", "up"])
        reached = reached.groupBy(*key).agg(F.count("*").alias("met"), F.max(F.col("depth") + F.col("steps")).alias("depth"))
        met = kept(met.unionByName(reached).groupBy(*key).agg(F.sum("met").alias("met"), F.max("depth").alias("depth")), "met")
        settled = met.join(several, [*key]).where("met = n").select(*key, "depth")
        settled = kept(settled, "depth")
        met = met.join(settled.select(*key), key, "left_anti")
        done = kept(done.unionByName(settled), "done")
    along = ends.join(done.select("conv_id", F.col("call_id").alias("up"), "depth"), ["conv_id", "up"])
    along = along.select(*key, (F.col("depth") + F.col("steps")).alias("depth"))
    return done.join(several.select(*key), key, "left_semi").unionByName(along)


def depths(calls: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``conv_id``, ``call_id``, ``depth``: 0 without dependencies, else one more than the deepest of them.

    Calls on a cycle, or behind one, are left out; references to calls that do not exist are ignored. Conversations
    of up to ``at_once`` dependencies are ordered by one task each, larger ones by joins, with one result.
    """
    nodes = calls.select("conv_id", "call_id", "needs")
    edges = nodes.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("needed"))
    known = nodes.select("conv_id", F.col("call_id").alias("needed"))
    edges = kept(edges.join(known, ["conv_id", "needed"]).select("conv_id", "call_id", "needed"), "needs")
    large = kept(edges.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > at_once).select("conv_id"), "large")
    result = nodes.join(edges.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "call_id", F.lit(0).cast("long").alias("depth")
    )
    listed = edges.join(large, "conv_id", "left_anti").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "needed")).alias("needs"))
    small = listed.select("conv_id", F.inline(_ordered("needs")))
    result = result.unionByName(small)
    if large.head(1):
        result = result.unionByName(_joined_depths(kept(edges.join(large, "conv_id"), "large-needs")))
    return result


def formatted(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """The chat as lines of canonical JSON: keys sorted, no blanks, one row for each message and each call.

    ``messages`` has ``conv_id``, ``turn``, ``role``, ``text``. Rows have ``conv_id``, ``turn``, ``place``, ``kind``
    (``message`` or ``call``), ``call_id``, ``depth``, ``status``, ``problems`` and ``json``. Sorting calls by conversation
    and depth, then turn and place, is a topological order; ``depth`` is null on a cycle. ``status`` of a call is
    ``linked``, ``unanswered`` or ``early`` (its result stands before it); of results without a call ``orphan``. The first
    of several calls or results with one id counts, by turn and content; its problems then name
    the ``repeated id``. Calls and results without an id are linked with nothing, each a row with the problem ``missing
    id``. Arguments that cannot be read as JSON are written as a string of their text.

    Equal rows are one message. Rows without a conversation or turn are left out; a null role or text is written as
    null; messages that are no valid JSON are ordinary messages; texts of any length are written whole. An empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    messages = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text").distinct()
    first = ["conv_id", "call_id"]
    every, answers = calls_of(messages), results_of(messages)
    row = F.struct("turn", "place", "name", "arguments")
    calls = every.where("call_id IS NOT NULL").groupBy(*first).agg(F.min(row).alias("row"), F.count("*").alias("uses")).select(*first, "row.*", "uses")
    calls = kept(
        calls.withColumn("needs", F.regexp_extract_all("arguments", F.lit(_REFERENCE), 1)), "calls"
    )
    results = answers.where("call_id IS NOT NULL").groupBy(*first).agg(F.min(F.struct("result_turn", "content")).alias("result"))
    results = results.select(*first, "result.*")

    linked = calls.join(results, first, "full_outer").join(depths(calls), first, "left")
    for without_id in (every, answers):
        linked = linked.unionByName(without_id.where("call_id IS NULL"), allowMissingColumns=True)
    linked = linked.withColumn("checked", _checks(schemas)("name", "arguments"))
    status = (
        F.when(F.col("turn").isNull(), "orphan")
        .when(F.col("result_turn").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    others = F.to_json(
        F.struct(F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("content").alias("result")),
        {"ignoreNullFields": "false"},
    )
    line = F.concat(F.lit('{"arguments":'), "checked.text", F.lit(","), F.substr(others, F.lit(2)))
    no_problem = F.array().cast("array<string>")
    problems = F.concat(
        F.when(F.col("turn").isNull(), no_problem).otherwise(F.col("checked.problems")),
        F.when(F.col("uses") > 1, F.array(F.lit("repeated id"))).otherwise(no_problem),
        F.when(F.col("call_id").isNull(), F.array(F.lit("missing id"))).otherwise(no_problem),
    )
    call_rows = linked.select(
        "conv_id",
        F.coalesce("turn", "result_turn").alias("turn"),
        F.coalesce("place", F.lit(0)).alias("place"),
        F.lit("call").alias("kind"),
        "call_id",
        F.col("depth").cast("int").alias("depth"),
        status.alias("status"),
        F.concat_ws("; ", problems).alias("problems"),
        line.alias("json"),
    )
    spoken = messages.select(
        "conv_id",
        "turn",
        F.lit(-1).alias("place"),
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("string").alias("status"),
        F.lit("").alias("problems"),
        F.to_json(F.struct(F.col("text").alias("content"), "conv_id", "role", "turn"), {"ignoreNullFields": "false"}).alias("json"),
    )
    return reduce(DataFrame.unionByName, [spoken, call_rows])


SEARCH: Schemas = {"search": {"query": ("string", True), "limit": ("integer", True), "after": ("string", False)}}


def as_tool_chat(conversations: DataFrame) -> DataFrame:
    """Conversations told as tool use: every user turn is answered by a call, whose result is the next turn.

    A call names the one before it as what it needs, so calls form chains. Every seventh user turn leaves out an argument
    and every eleventh gives a number as a string, so that there is something to find.
    """
    rows = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    own = F.concat_ws("-", F.lit("call"), "conv_id", "turn")
    key = F.col("conv_id") + F.col("turn")
    limit = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.lit('"5"')).otherwise(F.lit("5"))
    query = F.to_json(F.struct(F.col("text").alias("query")))
    before = F.concat_ws("-", F.lit("call"), "conv_id", F.col("turn") - 2)
    need = F.when(F.col("turn") > 1, F.concat(F.lit(',"after":"$ref:'), before, F.lit('"')))
    arguments = F.concat(
        F.substring(query, F.lit(1), F.length(query) - 1),
        F.coalesce(F.concat(F.when(F.col("text").isNull(), "").otherwise(","), F.lit('"limit":'), limit), F.lit("")),
        F.coalesce(need, F.lit("")),
        F.lit("}"),
    )
    call = F.concat(
        F.lit('{"tool_calls":[{"id":"'), own, F.lit('","name":"search","arguments":'), arguments, F.lit("}]}")
    )
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    answer = F.to_json(
        F.struct(
            F.concat_ws("-", F.lit("call"), "conv_id", F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")
        )
    )
    answered = rows.where("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), answer.alias("text"))
    return rows.where("role IS NULL OR role != 'assistant'").unionByName(asked).unionByName(answered)


# formatted(as_tool_chat(conversations), SEARCH), for turns that hold one text each.
ORACLE_SQL = r"""
WITH said AS (
    SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), asked AS (
    SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, to_json(text)::VARCHAR AS query,
           CASE WHEN (conv_id + turn) % 7 = 0 THEN NULL WHEN (conv_id + turn) % 11 = 0 THEN '"5"' ELSE '5' END AS most,
           CASE WHEN turn > 1 THEN '"$ref:call-' || conv_id || '-' || (turn - 2) || '"' END AS need
    FROM said WHERE role = 'user'
), chained AS (
    SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM asked
), calls AS (
    SELECT a.*, row_number() OVER (PARTITION BY a.conv_id, a.turn % 2, c.chain ORDER BY a.turn) - 1 AS depth
    FROM asked a JOIN chained c ON a.conv_id = c.conv_id AND a.turn = c.turn
), results AS (
    SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, to_json(text)::VARCHAR AS content
    FROM said WHERE role = 'assistant'
), messages AS (
    SELECT conv_id, turn, role, text FROM said WHERE role IS DISTINCT FROM 'assistant'
    UNION ALL
    SELECT conv_id, turn, 'assistant', '{"tool_calls":[{"id":"' || call_id || '","name":"search","arguments":{"query":' || query
           || coalesce(',"limit":' || most, '') || coalesce(',"after":' || need, '') || '}}]}'
    FROM asked
    UNION ALL
    SELECT conv_id, turn, 'tool', '{"tool_call_id":"' || call_id || '","content":' || content || '}' FROM results
)
SELECT conv_id, turn, -1 AS place, 'message' AS kind, NULL::VARCHAR AS call_id, NULL::INTEGER AS depth, NULL::VARCHAR AS status,
       '' AS problems,
       '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"conv_id":' || conv_id
       || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"turn":' || turn || '}' AS json
FROM messages
UNION ALL
SELECT coalesce(c.conv_id, r.conv_id), coalesce(c.turn, r.turn), 0, 'call', coalesce(c.call_id, r.call_id), c.depth::INTEGER,
       CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END,
       CASE WHEN c.turn IS NULL THEN '' WHEN c.most IS NULL THEN 'missing limit' WHEN c.most = '"5"' THEN 'limit is no integer' ELSE '' END,
       '{"arguments":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE
           '{' || coalesce('"after":' || c.need || ',', '') || coalesce('"limit":' || c.most || ',', '') || '"query":' || c.query || '}' END
       || ',"id":"' || coalesce(c.call_id, r.call_id) || '","name":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '"search"' END
       || ',"result":' || coalesce(r.content, 'null') || '}'
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""
