"""Tool-call linking for chat data.

Calls and results meet in a hash join on conversation and call id.  A call may
name calls that it comes after: `after` is one id or an array of ids.  Its
position is the length of the longest way to it, so each call has a higher one
than all it comes after.  A conversation of at most LOCAL links is ordered in
one step.  In longer ones no conversation is gathered: chains, where each call
comes after one other, are taken by pointer jumping, which doubles the distance
each round, and calls after several others are settled in topological rounds.
Arguments are checked against JSON schemas and written as canonical
JSON: sorted keys, no white space, UTF-8 (lone surrogates as escapes), floats
that are whole numbers as integers.

Defined results: ids count within their conversation, null conversations
being one; results without a conv_id column meet their call id in every
conversation; calls with a null id are left out; repeated call ids each give a
row with their number, and a call after them comes after the smallest one; the
smallest result of a call is in `json`, their number and a sum of digests over
all of them beside it; results without a call are in orphan_results(); unknown
calls in `after` don't count; calls on or after a cycle
have a null position and status ``cycle``; null arguments are an empty object;
unreadable ones give status ``invalid`` and null JSON; empty tables give an
empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.util import stored

SURROGATE = re.compile("[\ud800-\udfff]")
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Words of a schema that say nothing about validity.
NOTES = frozenset("$schema $id $anchor $comment $defs definitions title description default examples example deprecated readOnly writeOnly format contentEncoding contentMediaType".split())
#: Calls with an `after` of a conversation that one task orders at once; longer conversations go round by round.
LOCAL = 10_000


def canonical(value) -> str:
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def escaped(text: str) -> str:
    """Lone surrogates, which UTF-8 doesn't have, as the escapes that JSON has for them."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def is_type(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in ("integer", "number"):
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, TYPES[kind])


def equal(a, b) -> bool:
    """JSON equality: true is not 1, 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a == b


def problems(value, schema: dict | bool, at: str = "$", root: dict | bool | None = None) -> list[str]:
    """What a value breaks of a JSON schema; a word of the schema that isn't known is a problem too, not passed over."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed here"]
    root = schema if root is None else root
    if not isinstance(schema, dict):
        return [f"{at}: schema is neither an object nor a boolean"]
    found: list[str] = []
    below = lambda x, s, where=at: problems(x, s, where, root)
    for word, s in schema.items():
        if word in NOTES or word in ("properties", "patternProperties", "additionalProperties", "prefixItems", "items", "then", "else"):
            continue  # notes, and what is read with others below
        try:
            found += _word(value, word, s, at, below, root, schema)
        except (TypeError, KeyError, IndexError, AttributeError, regex.error, ValueError):
            found.append(f"{at}: schema word {word} has a value that can't be read")
    if isinstance(value, dict):
        found += _members(value, schema, at, below)
    if isinstance(value, list):
        first = schema.get("prefixItems", [])
        rest = schema.get("items", True)
        if isinstance(rest, list):  # the older form of prefixItems
            first, rest = rest, schema.get("additionalItems", True)
        for i, x in enumerate(value):
            found += below(x, first[i] if i < len(first) else rest, f"{at}[{i}]")
    return found


def _word(value, word: str, s, at: str, below: Callable, root, schema: dict) -> list[str]:
    """Problems with one word of a schema."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    text, many, members = isinstance(value, str), isinstance(value, list), isinstance(value, dict)
    if word == "type":
        kinds = s if isinstance(s, list) else [s]
        if unknown := [k for k in kinds if k not in TYPES and k not in ("integer", "number")]:
            return [f"{at}: unknown type {unknown[0]}"]
        return [] if any(is_type(value, k) for k in kinds) else [f"{at}: not {' or '.join(kinds)}"]
    if word == "enum":
        return [] if any(equal(value, x) for x in s) else [f"{at}: not in enum"]
    if word == "const":
        return [] if equal(value, s) else [f"{at}: not the constant"]
    if word == "$ref":
        target = root
        if not s.startswith("#"):
            return [f"{at}: reference {s} is outside the schema"]
        for step in filter(None, s[1:].split("/")):
            step = step.replace("~1", "/").replace("~0", "~")
            target = target[int(step)] if isinstance(target, list) else target[step]
        return below(value, target)
    if word == "allOf":
        return [p for x in s for p in below(value, x)]
    if word == "anyOf":
        return [] if any(not below(value, x) for x in s) else [f"{at}: none of anyOf"]
    if word == "oneOf":
        return [] if sum(not below(value, x) for x in s) == 1 else [f"{at}: not one of oneOf"]
    if word == "not":
        return [f"{at}: what must not be"] if not below(value, s) else []
    if word == "if":
        branch = "else" if below(value, s) else "then"
        return below(value, schema.get(branch, True))
    if word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
        broken = number and {"minimum": lambda: value < s, "maximum": lambda: value > s, "exclusiveMinimum": lambda: value <= s, "exclusiveMaximum": lambda: value >= s, "multipleOf": lambda: Fraction(str(value)) % Fraction(str(s)) != 0}[word]()
        return [f"{at}: {({'minimum': 'below minimum', 'maximum': 'above maximum'} | {'multipleOf': 'not a multiple'}).get(word, 'outside ' + word)}"] * broken
    if word in ("minLength", "maxLength", "pattern"):
        broken = text and (len(value) < s if word == "minLength" else len(value) > s if word == "maxLength" else not regex.search(s, value))
        return [f"{at}: {dict(minLength='too short', maxLength='too long', pattern='not of the pattern')[word]}"] * bool(broken)
    if word in ("minItems", "maxItems"):
        return [f"{at}: too {'few' if word == 'minItems' else 'many'} items"] * (many and (len(value) < s if word == "minItems" else len(value) > s))
    if word == "uniqueItems":
        return [f"{at}: items repeat"] * (bool(s) and many and len({canonical(x) for x in value}) < len(value))
    if word == "contains":
        return [f"{at}: no item as asked for"] * (many and all(below(x, s) for x in value))
    if word in ("minProperties", "maxProperties"):
        return [f"{at}: too {'few' if word == 'minProperties' else 'many'} members"] * (members and (len(value) < s if word == "minProperties" else len(value) > s))
    if word == "required":
        return [f"{at}.{k}: missing" for k in s if k not in value] if members else []
    if word == "propertyNames":
        return [p for k in value for p in below(k, s, f"{at}.{k}")] if members else []
    if word == "dependentRequired":
        return [f"{at}.{n}: missing" for k, names in s.items() if k in value for n in names if n not in value] if members else []
    if word == "additionalItems" and isinstance(schema.get("items"), list):
        return []
    if word == "nullable":
        return []
    return [f"{at}: unknown schema word {word}"]


def _members(value: dict, schema: dict, at: str, below: Callable) -> list[str]:
    found, known, patterns = [], schema.get("properties", {}), schema.get("patternProperties", {})
    others = schema.get("additionalProperties", True)
    for k, x in value.items():
        rules = ([known[k]] if k in known else []) + [s for p, s in patterns.items() if regex.search(p, k)]
        for s in rules:
            found += below(x, s, f"{at}.{k}")
        if not rules:
            found += [f"{at}.{k}: unknown"] if others is False else below(x, others, f"{at}.{k}")
    return found


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> F.Column:
    """Equal keys (null: equal); the right side's are named with __ before."""
    same = F.lit(True)
    for c in names:
        same &= left[c].eqNullSafe(right[f"__{c}"])
    return same


def _named(df: DataFrame, keys: dict[str, str], *others: str) -> DataFrame:
    return df.select(*[F.col(old).alias(f"__{new}") for old, new in keys.items()], *others)


def _before(calls: DataFrame) -> F.Column:
    """`after` as an array of ids."""
    if calls.schema["after"].dataType.simpleString() == "string":
        return F.when(F.col("after").isNotNull(), F.array("after"))
    return F.array_sort(F.array_distinct(F.filter("after", lambda x: x.isNotNull())))


def longest_ways(edges: list[tuple[str, str]]) -> dict[str, int | None]:
    """Of (call, a call it comes after) the longest way to each call with one; None on or after a cycle."""
    before, after = defaultdict(set), defaultdict(list)
    for call, earlier in edges:
        if earlier not in before[call]:
            before[call].add(earlier)
            after[earlier].append(call)
    open_, at = {c: len(b) for c, b in before.items()}, defaultdict(int)
    ready = [c for c in after if c not in before]
    out: dict[str, int | None] = dict.fromkeys(before)
    while ready:
        c = ready.pop()
        for later in after[c]:
            at[later] = max(at[later], at[c] + 1)
            open_[later] -= 1
            if not open_[later]:
                out[later] = at[later]
                ready.append(later)
    return out


def positions(calls: DataFrame, local: int = LOCAL) -> DataFrame:
    """(conv_id, call_id, position): the longest way to the call over `after`; null on or after a cycle.

    One row for each conv_id and call_id; of repeated calls the smallest row
    counts.  A conversation of at most `local` links is one bounded row, which a
    task orders at once; longer ones are settled over all tasks.
    """
    calls = calls.filter("call_id IS NOT NULL").withColumn("after", _before(calls))
    calls = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("name", "arguments", "after")).alias("c")).select("conv_id", "call_id", "c.after")
    own = _named(calls, {"conv_id": "conv_id", "call_id": "call_id"})
    wanted = calls.select("conv_id", F.col("call_id").alias("of"), F.explode("after").alias("call_id"))
    edges = wanted.join(own, _same(wanted, own, ["conv_id", "call_id"])).select("conv_id", F.col("of").alias("call_id"), F.col("call_id").alias("next"))
    edges = stored(edges, "edges")
    counted = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("next").alias("next"))
    several = _named(counted, {"conv_id": "conv_id", "call_id": "call_id"}, "n", "next")
    nodes = calls.join(several, _same(calls, several, ["conv_id", "call_id"]), "left").select("conv_id", "call_id", F.coalesce("n", F.lit(0)).alias("n"), "next")
    nodes = stored(nodes, "calls")
    sizes = stored(edges.groupBy("conv_id").count(), "sizes")
    long_ = _named(sizes.filter(F.col("count") > local), {"conv_id": "conv_id"})
    short = _named(sizes.filter(F.col("count") <= local), {"conv_id": "conv_id"})
    lists = edges.join(short, _same(edges, short, ["conv_id"]), "left_semi").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "next")).alias("links"))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [longest_ways([(x["call_id"], x["next"]) for x in links]) for links in b.column(1).to_pylist()]
            at = pa.array([i for i, g in enumerate(got) for _ in g], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([c for g in got for c in g], b.column(1).type.value_type.field("call_id").type), pa.array([p for g in got for p in g.values()], pa.int64())], ["conv_id", "call_id", "position"])

    at_once = lists.mapInArrow(ordered, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, position long")
    first = nodes.filter("n = 0").select("conv_id", "call_id", F.lit(0).cast("long").alias("position"))
    if long_.isEmpty():
        return first.unionByName(at_once)
    part = lambda df: df.join(long_, _same(df, long_, ["conv_id"]), "left_semi")
    short_first = first.join(long_, _same(first, long_, ["conv_id"]), "left_anti")
    return short_first.unionByName(at_once).unionByName(_in_rounds(part(nodes), part(edges)))


def _in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Positions of conversations of any length: chains by pointer jumping, calls after several others in topological rounds."""
    nodes, edges = stored(nodes, "calls"), stored(edges, "edges")
    stops = _named(nodes.filter("n <> 1"), {"conv_id": "conv_id", "call_id": "next"}, F.lit(True).alias("stop"))
    chains = nodes.filter("n = 1")
    state = stored(chains.join(stops, _same(chains, stops, ["conv_id", "next"]), "left").select("conv_id", "call_id", "next", F.lit(1).cast("long").alias("steps"), F.coalesce("stop", F.lit(False)).alias("done")), "chains")
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.filter("NOT done").isEmpty():
            break
        far = _named(state, {"conv_id": "conv_id", "call_id": "next"}, F.col("next").alias("beyond"), F.col("steps").alias("more"), F.col("done").alias("there"))
        open_ = state.filter("NOT done")
        open_ = open_.join(far, _same(open_, far, ["conv_id", "next"]))
        moved = open_.select("conv_id", "call_id", F.col("beyond").alias("next"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done"))
        state = stored(state.filter("done").unionByName(moved), "chains")
    # From here on only calls after none or several count; chains hang on them.
    level = nodes.filter("n = 0").select("conv_id", "call_id", F.lit(0).cast("long").alias("position"))
    merging = nodes.filter("n > 1").select("conv_id", "call_id", "n")
    if not merging.isEmpty():
        hang = _named(state.filter("done"), {"conv_id": "conv_id", "call_id": "next"}, F.col("next").alias("base"), "steps")
        owner = _named(merging, {"conv_id": "conv_id", "call_id": "call_id"}, "n")
        ways = edges.join(owner, _same(edges, owner, ["conv_id", "call_id"])).select("conv_id", "call_id", "n", "next")
        ways = ways.join(hang, _same(ways, hang, ["conv_id", "next"]), "left").select("conv_id", "call_id", "n", F.coalesce("base", "next").alias("next"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
        ways, level = stored(ways, "ways"), stored(level, "levels")
        while True:
            known = _named(level, {"conv_id": "conv_id", "call_id": "call_id"}, F.lit(True).alias("known"))
            waiting = ways.join(known, _same(ways, known, ["conv_id", "call_id"]), "left_anti")
            at = _named(level, {"conv_id": "conv_id", "call_id": "next"}, "position")
            ready = waiting.join(at, _same(waiting, at, ["conv_id", "next"])).groupBy("conv_id", "call_id", "n").agg(F.count("*").alias("m"), F.max(F.col("position") + F.col("steps")).alias("position"))
            ready = stored(ready.filter("m = n").select("conv_id", "call_id", "position"), "levels")
            if ready.isEmpty():
                break
            level = stored(level.unionByName(ready), "levels")
    base = _named(level, {"conv_id": "conv_id", "call_id": "next"}, "position")
    hung = state.join(base, _same(state, base, ["conv_id", "next"]) & F.col("done"), "left").select("conv_id", "call_id", (F.col("position") + F.col("steps")).alias("position"))
    settled = _named(level, {"conv_id": "conv_id", "call_id": "call_id"}, "position")
    others = nodes.filter("n <> 1")
    others = others.join(settled, _same(others, settled, ["conv_id", "call_id"]), "left").select("conv_id", "call_id", "position")
    return others.unionByName(hung)


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of results that no call has (null ids among them), all columns."""
    keys = [c for c in ("conv_id", "call_id") if c in results.columns]
    own = _named(calls.filter("call_id IS NOT NULL"), {c: c for c in keys})
    return results.join(own, _same(results, own, keys), "left_anti")


def content_number(content: str) -> F.Column:
    """The first 8 hex digits of a content's md5 as a number (null: 0)."""
    return F.coalesce(F.conv(F.substring(F.md5(content), 1, 8), 16, 10).cast("long"), F.lit(0).cast("long"))


def linked_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of results that some call has, all columns."""
    keys = [c for c in ("conv_id", "call_id") if c in results.columns]
    own = _named(calls.filter("call_id IS NOT NULL"), {c: c for c in keys})
    return results.join(own, _same(results, own, keys), "left_semi")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """call_id, conv_id, name, position, status, n_results, problems, json, n_calls, results_sum and results of each call.

    calls: conv_id, call_id, name, arguments (JSON), after (an id or an array of ids).  results: call_id,
    content and, as a rule, conv_id.  status: cycle, unknown_tool, invalid,
    no_result or ok.  n_calls: calls of this id in the conversation, over 1
    for repeats.  results_sum: content_number() of all contents, summed;
    results: all contents, in order.  linked_results() has them row by row.
    """
    keys = [c for c in ("conv_id", "call_id") if c in results.columns]
    calls = calls.filter("call_id IS NOT NULL").select("conv_id", "call_id", "name", "arguments", _before(calls).alias("after"))
    times = _named(calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls")), {"conv_id": "conv_id", "call_id": "call_id"}, "n_calls")
    places = _named(stored(positions(calls), "positions"), {"conv_id": "conv_id", "call_id": "call_id"}, F.col("position").alias("before"))
    # A repeat has the place that its own `after` gives it.
    sets = calls.filter("size(after) > 0").select("conv_id", "after").distinct()
    each = sets.select("conv_id", "after", F.explode("after").alias("call_id"))
    each = each.join(places, _same(each, places, ["conv_id", "call_id"])).groupBy("conv_id", "after").agg(F.max("before").alias("before"), F.bool_or(F.col("before").isNull()).alias("open"))
    each = _named(each, {"conv_id": "conv_id", "after": "after"}, "before", "open")
    joined = calls.join(each, _same(calls, each, ["conv_id", "after"]), "left")
    placed = F.when(F.col("open").isNull(), F.lit(0).cast("long")).when(~F.col("open"), F.col("before") + 1)
    joined = joined.select("conv_id", "call_id", "name", "arguments", placed.alias("position"))
    joined = joined.join(times, _same(joined, times, ["conv_id", "call_id"])).drop("__conv_id", "__call_id")
    answers = results.filter("call_id IS NOT NULL").groupBy(*keys).agg(F.min("content").alias("content"), F.count("*").alias("n_results"), F.sum(content_number("content")).alias("results_sum"), F.array_sort(F.collect_list(F.struct("content"))).alias("all"))
    answers = _named(answers, {c: c for c in keys}, "content", "n_results", "results_sum", F.transform("all", lambda x: x["content"]).alias("results"))
    joined = joined.join(answers, _same(joined, answers, keys), "left").drop(*[f"__{c}" for c in keys])
    joined = joined.withColumns({"n_results": F.coalesce("n_results", F.lit(0).cast("long")), "results_sum": F.coalesce("results_sum", F.lit(0).cast("long")), "results": F.coalesce("results", F.array().cast("array<string>"))})

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, wrong, texts = [], [], []
            for r in b.to_pylist():
                bad, args = [], None
                try:
                    args = json.loads(r["arguments"]) if r["arguments"] is not None else {}
                    bad = problems(args, schemas.get(r["name"], {}))
                    made = canonical({"call_id": r["call_id"], "name": r["name"], "position": r["position"], "arguments": args, "result": r["content"]})
                except (ValueError, RecursionError, OverflowError):
                    bad, made = ["$: unreadable"], None
                texts.append(made)
                wrong.append([escaped(x) for x in bad])
                status.append("cycle" if r["position"] is None else "unknown_tool" if r["name"] not in schemas else "invalid" if bad else "no_result" if not r["n_results"] else "ok")
            keep = [b.column(b.schema.get_field_index(c)) for c in ("call_id", "conv_id", "name", "position", "n_results")]
            more = [b.column(b.schema.get_field_index(c)) for c in ("n_calls", "results_sum", "results")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(status, pa.string()), pa.array(wrong, pa.list_(pa.string())), pa.array(texts, pa.string()), *more], ["call_id", "conv_id", "name", "position", "n_results", "status", "problems", "json", "n_calls", "results_sum", "results"])

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    return joined.mapInArrow(checked, f"call_id {kinds['call_id']}, conv_id {kinds['conv_id']}, name string, position long, n_results long, status string, problems array<string>, json string, n_calls long, results_sum long, results array<string>")
