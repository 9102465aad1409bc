"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Messages are rows, and stay rows. Linking and ordering work on narrow rows: the
ids of calls and results meet in a hash join on (conversation, call id), and so
do calls and the calls they depend on. Conversations up to LOCAL_MESSAGES
dependencies get their levels one after the other in one sorted pass; larger
ones by joins over all of them, in which chains of any length are followed by
pointer doubling. Texts move once, to meet the place of their message.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluice.llm import scratch

LOCAL_MESSAGES = 10_000
#: Levels of nesting beyond which arguments count as unparsable.
MOST_DEPTH = 200
CALL, RESULT = "call", "result"
_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What ``value`` violates of a JSON schema: type, enum, required, properties, additionalProperties, items, lengths, bounds and pattern."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: additional")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(v, schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            out.append(f"{at}: items")
        if isinstance(schema.get("items"), dict):
            for i, v in enumerate(value):
                out += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if _is(value, "number") and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        out.append(f"{at}: bounds")
    return out


def canonical(value: object) -> str:
    """JSON with sorted keys, no white space, and numbers in their shortest form; ValueError beyond MOST_DEPTH levels."""

    def plain(x: object, depth: int) -> object:
        if depth > MOST_DEPTH:
            raise ValueError("nested too deeply")
        if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v, depth + 1) for k, v in x.items()}
        return [plain(v, depth + 1) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value, 0), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _loads(text: object) -> tuple[object, str | None]:
    """The value of a JSON text and its canonical form; the form is None where the text is not usable JSON.

    Not usable are broken texts, keys that stand twice, numbers that are not
    finite, more than MOST_DEPTH levels, and strings with half a surrogate pair.
    """

    def unique(pairs: list[tuple[str, object]]) -> dict:
        if len(dict(pairs)) < len(pairs):
            raise ValueError("a key stands twice")
        return dict(pairs)

    def refuse(name: str) -> object:
        raise ValueError(name)

    def finite(number: str) -> float:
        if math.isinf(x := float(number)):
            raise ValueError(number)
        return x

    if not isinstance(text, str):
        return None, None
    try:
        value = json.loads(text, object_pairs_hook=unique, parse_constant=refuse, parse_float=finite)
        form = canonical(value)
        form.encode()
        return value, form
    except (ValueError, RecursionError):
        return None, None


def check_schemas(schemas: dict[str, dict]) -> dict[str, dict]:
    """``schemas``, or ValueError if one holds a pattern that does not compile."""
    work = [(name, s) for name, s in schemas.items()]
    while work:
        name, s = work.pop()
        if isinstance(s, dict):
            if isinstance(s.get("pattern"), str):
                try:
                    re.compile(s["pattern"])
                except re.error as e:
                    raise ValueError(f"schema of {name}: pattern {s['pattern']!r}: {e}") from e
            work += [(name, v) for v in s.values()]
        elif isinstance(s, list):
            work += [(name, v) for v in s]
    return dict(schemas)


KEYS = ["conv_id", "call_id"]


def _ids(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, has_call, has_result) of every id that a call or result carries."""
    one = messages.where(F.col("kind").isin(CALL, RESULT)).dropna(subset=KEYS)
    return one.groupBy(*KEYS).agg(F.bool_or(F.col("kind") == CALL).alias("has_call"), F.bool_or(F.col("kind") == RESULT).alias("has_result"))


def link(messages: DataFrame) -> DataFrame:
    """``messages`` with linked: a call that has a result, a result that has a call; null for other kinds.

    Ids link inside a conversation. Several results of a call all link to it;
    a null id or conversation links to nothing.
    """
    out = messages.drop("has_call", "has_result").join(_ids(messages).hint("shuffle_hash"), KEYS, "left")
    linked = F.when(F.col("kind") == CALL, F.coalesce("has_result", F.lit(False))).when(F.col("kind") == RESULT, F.coalesce("has_call", F.lit(False)))
    return out.withColumn("linked", linked).drop("has_call", "has_result")


def _needs(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, wanted): calls whose results a call waits for; wanted is null for a result that no call in the conversation has.

    Calls that repeat an id are one call, which waits for what any of them waits for.
    """
    wants = messages.where(F.col("kind") == CALL).dropna(subset=KEYS).select(*KEYS, F.explode("depends_on").alias("wanted")).distinct()
    there = _ids(messages).where("has_result").select("conv_id", F.col("call_id").alias("wanted"), "has_call")
    return wants.join(there.hint("shuffle_hash"), ["conv_id", "wanted"]).select(*KEYS, F.when(F.col("has_call"), F.col("wanted")).alias("wanted"))


def levels_of_one(needs: list[tuple[str, str | None]]) -> list[tuple[str, int]]:
    """(call, level) inside one conversation, by repeatedly taking what waits for nothing more; -1 for what is in or behind a cycle.

    A call is one level above the last result it waits for, a result one above its call.
    """
    waits: dict[str, int] = {}
    then: dict[str, list[str]] = {}
    level: dict[str, int] = {}
    for call, wanted in needs:
        waits.setdefault(call, 0)
        if wanted is None:
            level[call] = 1
        else:
            waits[call] += 1
            waits.setdefault(wanted, 0)
            then.setdefault(wanted, []).append(call)
    ready = [c for c, w in waits.items() if w == 0]
    for c in ready:
        level.setdefault(c, 0)
        for x in then.get(c, ()):
            level[x] = max(level.get(x, 0), level[c] + 2)
            waits[x] -= 1
            if waits[x] == 0:
                ready.append(x)
    done = set(ready)
    return [(c, level[c] if c in done else -1) for c in waits]


def _levels_in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Levels of conversations that arrive one after the other, holding one at a time."""
    now, held = None, []
    for pdf in frames:
        out = []
        for conv, call, wanted in pdf[[*KEYS, "wanted"]].itertuples(index=False, name=None):
            if conv != now and held:
                out += [(now, *x) for x in levels_of_one(held)]
                held = []
            now = conv
            held.append((call, wanted if isinstance(wanted, str) else None))
        yield pd.DataFrame(out, columns=[*KEYS, "level"])
    if held:
        yield pd.DataFrame([(now, *x) for x in levels_of_one(held)], columns=[*KEYS, "level"])


def _followed(single: DataFrame) -> DataFrame:
    """Calls (call_id, to, c, d) whose level is max(c, level of ``to`` + d), each followed as far as such calls lead.

    Two steps make one of the same form, so every round doubles the length.
    Calls that lead into a cycle are left pointing at one of its calls.
    """
    now, rounds = scratch.keep(single, "single"), 0
    most = now.count().bit_length() + 1
    while rounds < most:
        on = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("c").alias("c2"), F.col("d").alias("d2"))
        more = F.col("to2").isNotNull()
        after = now.join(on, ["conv_id", "to"], "left").select(
            *KEYS, F.coalesce("to2", "to").alias("to"), F.when(more, F.greatest(F.col("c"), F.col("c2") + F.col("d"))).otherwise(F.col("c")).alias("c"),
            F.when(more, F.col("d") + F.col("d2")).otherwise(F.col("d")).alias("d"), more.alias("moved"),
        )
        after = scratch.keep(after, "single")
        scratch.drop(now)
        now, rounds = after.drop("moved"), rounds + 1
        now.scratch_path = after.scratch_path
        if not after.where("moved").limit(1).count():
            break
    return now


def _levels_by_doubling(needs: DataFrame) -> DataFrame:
    """The same levels by joins over all conversations at once.

    An edge of call to ``wanted`` says: at least c, and at least the level of
    ``wanted`` plus d; wanted is null once that level is known. A round takes in
    what is known, settles calls without open edges, follows calls with a single
    one by doubling, and leads all edges to where those end. Only calls with
    several open edges each wait for a further round.
    """
    known = F.col("wanted").isNull()
    edges = needs.select(*KEYS, "wanted", F.when(known, 1).otherwise(0).alias("c"), F.lit(2).alias("d"))
    leaves = needs.where(~known).select("conv_id", F.col("wanted").alias("call_id")).distinct().join(needs.select(*KEYS).distinct(), KEYS, "left_anti")
    edges, done, idle = scratch.keep(edges, "edges"), scratch.keep(leaves.withColumn("level", F.lit(0)), "levels"), 0
    while idle < 2:
        told = done.select("conv_id", F.col("call_id").alias("wanted"), "level")
        taken = edges.join(told, ["conv_id", "wanted"], "left")
        now = F.when(F.col("level").isNotNull(), F.greatest(F.col("c"), F.col("level") + F.col("d"))).otherwise(F.col("c"))
        taken = taken.select(*KEYS, F.when(F.col("level").isNull(), F.col("wanted")).alias("wanted"), now.alias("c"), "d")
        taken = scratch.keep(taken.groupBy(*KEYS, "wanted").agg(F.max("c").alias("c"), F.max("d").alias("d")), "taken")
        node = scratch.keep(taken.groupBy(*KEYS).agg(F.max("c").alias("c"), F.count("wanted").alias("open"), F.max("wanted").alias("to"), F.max(F.when(F.col("wanted").isNotNull(), F.col("d"))).alias("d")), "calls")
        fresh = node.where("open = 0").select(*KEYS, F.col("c").alias("level"))
        single = _followed(node.where("open = 1").select(*KEYS, "to", "c", "d"))
        several = taken.join(node.where("open > 1").select(*KEYS), KEYS, "left_semi")
        ends = single.select("conv_id", F.col("call_id").alias("wanted"), F.col("to").alias("end"), F.col("c").alias("c2"), F.col("d").alias("d2"))
        led = several.join(ends, ["conv_id", "wanted"], "left").select(*KEYS, F.coalesce("end", "wanted").alias("wanted"), F.greatest(F.col("c"), F.coalesce(F.col("c2") + F.col("d"), F.lit(0))).alias("c"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))
        after = scratch.keep(led.union(single.select(*KEYS, F.col("to").alias("wanted"), "c", "d")), "edges")
        both = scratch.keep(done.union(fresh), "levels")
        idle = 0 if fresh.limit(1).count() else idle + 1
        scratch.drop(edges, done, taken, node, single)
        edges, done = after, both
    out = scratch.keep(done.union(edges.select(*KEYS).distinct().withColumn("level", F.lit(-1))), "levels")
    scratch.drop(edges, done)
    return out


def _numbered(messages: DataFrame, conversations: DataFrame, by: list[Column]) -> DataFrame:
    """(message, ordinal) of the messages of large conversations: their place in an order that is dealt by ranges."""
    order = ["conv_id", *by]
    rows = messages.join(conversations, "conv_id", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = scratch.keep(rows.select("conv_id", "message", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("row")), "ordered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    base = rows.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    rows = rows.join(F.broadcast(base), "part").select("conv_id", "message", (F.col("base") + F.col("row")).alias("place"))
    first = rows.groupBy("conv_id").agg(F.min("place").alias("first"))
    return rows.join(first, "conv_id").select("message", (F.col("place") - F.col("first")).alias("ordinal"))


def order(messages: DataFrame) -> DataFrame:
    """``messages`` with level and ordinal: a topological order of each conversation, ties by position.

    ``messages`` has conv_id, position, kind, call_id, depends_on and a unique
    message. level is 0 for a message that waits for nothing, else one more
    than the last message it waits for; -1 for messages in or behind a cycle,
    which come last. A call without call_id waits for nothing.
    """
    kind = dict(messages.dtypes)["conv_id"]
    count = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.size(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("edges"))
    large = scratch.keep(count.where((F.col("n") > LOCAL_MESSAGES) | (F.col("edges") > LOCAL_MESSAGES)).select("conv_id"), "large")
    some = bool(large.limit(1).count())
    needs = _needs(messages)
    local = needs.join(large, "conv_id", "left_anti") if some else needs
    levels = local.repartition("conv_id").sortWithinPartitions("conv_id").mapInPandas(_levels_in_order, f"conv_id {kind}, call_id string, level int")
    if some:
        levels = levels.union(_levels_by_doubling(needs.join(large, "conv_id", "left_semi")))
    waits = _ids(messages).join(levels, KEYS, "left")
    own = F.coalesce("own_level", F.lit(0))
    level = F.when(F.col("kind") == CALL, own).when((F.col("kind") == RESULT) & F.col("has_call"), F.when(own < 0, -1).otherwise(own + 1)).otherwise(0)
    out = messages.drop("has_call", "own_level").join(waits.select(*KEYS, "has_call", F.col("level").alias("own_level")).hint("shuffle_hash"), KEYS, "left").withColumn("level", level.cast("int")).drop("has_call", "own_level")
    last = F.when(F.col("level") < 0, 1).otherwise(0)
    by = [last, F.col("level"), F.col("position").asc_nulls_last(), F.col("message")]
    at = Window.partitionBy("conv_id").orderBy(*by)
    if not some:
        return out.withColumn("ordinal", (F.row_number().over(at) - 1).cast("long"))
    out = scratch.keep(out, "levelled")
    small = out.where("conv_id is null").unionByName(out.where("conv_id is not null").join(large, "conv_id", "left_anti"))
    numbers = small.select("message", (F.row_number().over(at) - 1).cast("long").alias("ordinal")).union(_numbered(out, large, by))
    return out.join(numbers, "message")


def format_messages(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Linked, ordered, validated and serialised messages.

    ``messages`` has conv_id, position, kind ('call', 'result' or anything
    else), call_id, name, arguments (JSON text), content and depends_on (ids
    of earlier calls); further columns are dropped. Added are linked, level and
    ordinal, valid and errors (calls only: arguments parse, are known by name in
    ``schemas`` and fit it) and json, the canonical text of the message without
    its null fields. Every row stays, repeated rows too.
    """
    names = ["conv_id", "position", "kind", "call_id", "name", "arguments", "content", "depends_on"]
    known = check_schemas(schemas)

    @F.pandas_udf("errors array<string>, json string")
    def judged(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for kind, call_id, name, arguments, content in batches:
            out = []
            for k, c, n, a, t in zip(kind, call_id, name, arguments, content, strict=True):
                n = n if isinstance(n, str) else None
                value, form = _loads(a)
                errors = None
                if k == CALL:
                    errors = ["unparsable"] if form is None else ["unknown name"] if n not in known else violations(value, known[n])
                fields = {"arguments": a, "call_id": c, "content": t, "kind": k, "name": n}
                parts = {x: json.dumps(v, ensure_ascii=False) for x, v in fields.items() if isinstance(v, str)}
                if form is not None:
                    parts["arguments"] = form
                out.append((errors, "{" + ",".join(f'"{x}":{v}' for x, v in parts.items()) + "}"))
            yield pd.DataFrame(out, columns=["errors", "json"])

    text = [F.col(c).cast(StringType()) for c in ("kind", "call_id", "name", "arguments", "content")]
    with scratch.only() as spared:
        rows = scratch.keep(messages.select(*names).withColumn("message", F.monotonically_increasing_id()), "messages")
        places = order(link(rows.select("message", "conv_id", "position", "kind", "call_id", "depends_on"))).select("message", "linked", "level", "ordinal")
        out = rows.join(places, "message").withColumn("judged", judged(*text))
        errors = F.col("judged.errors")
        valid = F.when(F.col("kind") == CALL, F.size(errors) == 0)
        out = scratch.keep(out.select(*names, "linked", "level", "ordinal", valid.alias("valid"), errors.alias("errors"), F.col("judged.json").alias("json")), "formatted")
        spared.append(out)
    return out


#: The one tool that plain conversations use: a user's turn asks it, the assistant's next turn answers.
REPLY = {"reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}}


def as_calls(conversations: DataFrame) -> DataFrame:
    """Turns as messages: a user's turn calls ``reply``, an assistant's turn answers the turn before it, others are plain.

    A call depends on the call two turns earlier, so that a dialogue is one chain.
    """
    turn, role = F.col("turn"), F.lower("role")
    kind = F.when(role == "user", CALL).when(role == "assistant", RESULT).otherwise(role)
    number = F.when(role == "user", turn).when(role == "assistant", turn - 1)
    arguments = F.when(role == "user", F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn"))))
    return conversations.select(
        "conv_id", turn.alias("position"), kind.alias("kind"), F.concat(F.lit("turn-"), number.cast("string")).alias("call_id"), F.when(role == "user", "reply").alias("name"), arguments.alias("arguments"),
        F.when(role == "user", F.lit(None)).otherwise(F.col("text")).alias("content"), F.when(role == "user", F.array(F.concat(F.lit("turn-"), (turn - 2).cast("string")))).alias("depends_on"),
    )
