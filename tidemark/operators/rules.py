"""Alert rules: conditions over record fields, alerts, and cooldown."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import unused
from tidemark.functions.values import Value, missing_value, python_text, typed_value, variant_field, variant_value
from tidemark.operators.parts import PART_ROWS, by_key, key_cuts, part_of

#: Fixed value: the operators, longer ones first.
OPERATORS = ("==", "!=", ">=", "<=", ">", "<", "contains")
_condition = re.compile(r"^\s*([\w.]+)\s*(==|!=|>=|<=|>|<|contains)\s*(.+?)\s*$", re.S)
_quoted = re.compile(r'"[^"]*"')
#: What reads as a number: decimal or (with an exponent) hexadecimal, digits apart by single underscores, or not finite.
_decimal = re.compile(r"[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?", re.A)
_hexadecimal = re.compile(r"[+-]?0[xX](_?[0-9a-fA-F])*\.?([0-9a-fA-F](_?[0-9a-fA-F])*)?[pP][+-]?\d+", re.A)
_not_finite = re.compile(r"[+-]?inf(inity)?|nan", re.I | re.A)


@dataclass
class Comparison:
    field: str
    op: str
    literal: str | float | bool

    def __str__(self) -> str:
        shown = f'"{self.literal}"' if isinstance(self.literal, str) else python_text(self.literal)
        return f"{self.field} {self.op} {shown}"

    def column(self, value: Value) -> Column:
        """False for a missing field. Two numbers compare as doubles, everything else as text in byte order.

        Nothing but `!=` holds for a NaN on either side, as among machine numbers and unlike Spark's order.
        """
        literal = F.lit(python_text(self.literal))
        if self.op == "contains":
            return F.coalesce(value.present & F.contains(value.text(), literal), F.lit(False))
        compare: Callable[[Column, Column], Column] = {
            "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
            ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
        }[self.op]
        if not isinstance(self.literal, float):
            return F.coalesce(value.present & compare(value.text(), literal), F.lit(False))
        if math.isnan(self.literal):
            numbers = F.lit(self.op == "!=")
        else:
            numbers = F.when(F.isnan(value.number), F.lit(self.op == "!=")).otherwise(compare(value.number, F.lit(self.literal)))
        return F.coalesce(value.present & F.when(value.is_number, numbers).otherwise(compare(value.other, literal)), F.lit(False))


def parse_literal(text: str) -> str | float | bool:
    """A string in double quotes, true or false, a number, or a bare string; a number out of range is a bare string."""
    if len(text) >= 2 and text[0] == text[-1] == '"':
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if _not_finite.fullmatch(text):
        return float(text)
    found = float(text) if _decimal.fullmatch(text) else text
    if _hexadecimal.fullmatch(text):
        try:
            found = float.fromhex(text.replace("_", ""))
        except (OverflowError, ValueError):
            return text
    return text if isinstance(found, float) and math.isinf(found) else found


@dataclass
class Condition:
    """Comparisons joined by one connective, AND or OR."""

    parts: list[Comparison]
    connective: str = "AND"

    @classmethod
    def parse(cls, text: str) -> Condition:
        """'temperature > 80 AND status == "error"', with connectives in any case.

        Double quotes hide connectives; mixing AND with OR is an error.
        """
        hidden = _quoted.sub(lambda m: "\0" * len(m[0]), text)
        cuts = [(m.start(), m.end(), m[1].upper()) for m in re.finditer(r"\s(AND|OR)\s", hidden, re.I)]
        kinds = {c[2] for c in cuts}
        if len(kinds) > 1:
            raise ValueError(f"AND and OR do not mix: {text!r}")
        ends, starts = [c[0] for c in cuts] + [len(text)], [0] + [c[1] for c in cuts]
        parts = []
        for a, z in zip(starts, ends, strict=True):
            m = _condition.match(text[a:z])
            if not m:
                raise ValueError(f"not a comparison: {text[a:z]!r}")
            parts.append(Comparison(m[1], m[2], parse_literal(m[3])))
        return cls(parts, kinds.pop() if kinds else "AND")

    def __str__(self) -> str:
        return f" {self.connective} ".join(map(str, self.parts))

    def column(self, value_of: Callable[[str], Value]) -> Column:
        join = (lambda a, b: a & b) if self.connective == "AND" else (lambda a, b: a | b)
        return reduce(join, [p.column(value_of(p.field)) for p in self.parts])

    def typed(self, df: DataFrame) -> Column:
        """Over a frame's columns; a column it lacks is a missing field."""
        kinds = {f.name: f.dataType for f in df.schema}

        def value(name: str) -> Value:
            if name not in kinds:
                return missing_value()
            return typed_value(F.col(f"`{name}`"), kinds[name])

        return self.column(value)

    def on_json(self, record: Column) -> Column:
        """Over a VARIANT record. A lambda binds the record and each field, so they are parsed and looked up once."""
        return F.exists(F.array(record), self.of_record)

    def of_record(self, record: Column) -> Column:
        """Over a VARIANT record that costs nothing to read again."""
        join = (lambda a, b: a & b) if self.connective == "AND" else (lambda a, b: a | b)
        one = lambda p: F.exists(F.array(variant_field(record, p.field)), lambda v: p.column(variant_value(v)))
        return reduce(join, map(one, self.parts))


@dataclass
class Rule:
    name: str
    condition: Condition | str
    cooldown_ns: int = 0
    parsed: Condition = field(init=False)

    def __post_init__(self):
        self.parsed = Condition.parse(self.condition) if isinstance(self.condition, str) else self.condition


def alerts(df: DataFrame, rules: Iterable[Rule], data: Column, store: str = "", json: str | None = None) -> DataFrame:
    """rule_name, condition, cooldown_ns, ts_ns, data, store_name: one row for each record and rule that it meets.

    All rules are tested in one pass. `json` names a payload column; without it the typed columns count.
    """
    rules = list(rules)

    def met(test: Callable[[Rule], Column]) -> Column:
        about = lambda r: F.struct(F.lit(r.name).alias("rule_name"), F.lit(str(r.parsed)).alias("condition"), F.lit(r.cooldown_ns).cast("long").alias("cooldown_ns"))
        return F.array_compact(F.array(*[F.when(test(r), about(r)) for r in rules]))

    if json:
        record = F.try_parse_json(F.col(json).cast("string"))
        found = F.element_at(F.transform(F.array(record), lambda v: met(lambda r: r.parsed.of_record(v))), 1)
    else:
        found = met(lambda r: r.parsed.typed(df))
    rows = df.select("ts_ns", data.alias("data"), F.explode(found).alias("rule"))
    return rows.select("rule.rule_name", "rule.condition", "rule.cooldown_ns", "ts_ns", "data", F.lit(store).alias("store_name"))


def fires(times: Iterable[int], cooldown_ns: int) -> list[bool]:
    """Whether each of the ascending times fires: the first does, then any that is cooldown after the last that did."""
    last, out = None, []
    for t in times:
        fired = last is None or t - last >= cooldown_ns
        if fired:
            last = t
        out.append(fired)
    return out


def fired(times: np.ndarray, cooldown_ns: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """Which of the ascending times fire after a last fire, and the last fire after them; the work is by fires, not by times."""
    if cooldown_ns <= 0:
        return np.ones(len(times), bool), int(times[-1]) if len(times) else last
    out, at = np.zeros(len(times), bool), 0 if last is None else int(np.searchsorted(times, last + cooldown_ns))
    while at < len(times):
        out[at], last = True, int(times[at])
        at = int(np.searchsorted(times, last + cooldown_ns))
    return out, last


def fire_map(times: np.ndarray, cooldown_ns: int) -> tuple[np.ndarray, np.ndarray]:
    """What these hits make of any fire before them: if the first to fire is one up to (ascending) times, what fires last.

    Only a hit within a cooldown of the first hit, or the next after it, can be the first to fire.
    """
    n = len(times)
    if cooldown_ns <= 0:
        return times[-1:], times[-1:]
    follow = np.searchsorted(times, times + cooldown_ns)
    jump = np.where(follow < n, follow, np.arange(n))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    firsts = min(n, int(follow[0]) + 1)
    after = times[jump[:firsts]]
    ends = np.flatnonzero(np.r_[after[1:] != after[:-1], True])
    return times[:firsts][ends], after[ends]


def with_cooldown(found: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The alerts that fire, by event time and rule name.

    Whether a hit fires depends on the rule's last fire before it. Time is cut into parts; the hits of a part are
    first summed up (which last fire follows from which one before), the sums of a rule are chained in order, and
    then all parts are gone through side by side, as streams with one number of state.
    """
    cuts = key_cuts(found, "ts_ns", part_rows)
    part, before = unused(found.columns, "part", "last_fire")
    keyed = found.withColumn(part, part_of(F.col("ts_ns"), cuts).cast("int"))
    if cuts:
        keyed = keyed.join(fires_before(keyed.select("rule_name", part, "ts_ns", "cooldown_ns"), part, before), ["rule_name", part])
    else:
        keyed = keyed.withColumn(before, F.lit(None).cast("long"))
    dealt = keyed.select(*found.columns, part, before).repartition("rule_name", part).sortWithinPartitions("rule_name", part, "ts_ns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for key, rows in by_key(batches, "rule_name", part):
            if key != at:
                at, last = key, rows.column(before)[0].as_py()
            keep, last = fired(rows.column("ts_ns").to_numpy(), rows.column("cooldown_ns")[0].as_py(), last)
            yield rows.filter(pa.array(keep))

    return dealt.mapInArrow(run, dealt.schema).drop(part, before)


def fires_before(hits: DataFrame, part: str, before: str) -> DataFrame:
    """(rule_name, part, before): each rule's last fire before each part with hits; null before the first."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, 0, []]

        def row() -> pa.RecordBatch:
            starts, after = fire_map(np.concatenate(held[2]), held[1])
            columns = [pa.array([held[0][0]]), pa.array([held[0][1]], pa.int32()), pa.array([held[1]], pa.int64())]
            columns += [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (starts, after)]
            return pa.RecordBatch.from_arrays(columns, ["rule_name", part, "cooldown_ns", "starts", "after"])

        for key, rows in by_key(batches, "rule_name", part):
            if key != held[0]:
                if held[2]:
                    yield row()
                held[:] = [key, rows.column("cooldown_ns")[0].as_py(), []]
            held[2].append(rows.column("ts_ns").to_numpy())
        if held[2]:
            yield row()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = None, None
        for batch in batches:
            out = []
            for rule, number, cooldown, starts, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rule != name:
                    name, last = rule, None
                out.append((rule, number, last))
                k = 0 if last is None or cooldown <= 0 else bisect_left(starts, last + cooldown)
                last = after[k] if k < len(after) else last
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["rule_name", part, before])

    sums = hits.repartition("rule_name", part).sortWithinPartitions("rule_name", part, "ts_ns")
    sums = sums.mapInArrow(summed, f"rule_name string, {part} int, cooldown_ns long, starts array<long>, after array<long>")
    return sums.repartition("rule_name").sortWithinPartitions("rule_name", part).mapInArrow(chained, f"rule_name string, {part} int, {before} long")
