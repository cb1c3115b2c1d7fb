"""Metadata editors: killers that test an attribute, and operators that change one.

Each is a small object with ``apply(df)``. All are column expressions over ``attribute`` (so that they
also work on the members of an ensemble, see ``group.apply_to_members``); chains collapse into one
projection. A missing attribute never kills in a comparison, but kills in arithmetic. Dead rows keep
their values. NaN is above all numbers, as in Spark's order: "greater than" kills it, "less than" does not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from quakeframe.state import ELOG, LIVE, attribute, kill_if, log_entry, with_state


class Killer:
    """A test on a row; ``condition`` is true (never null) where the row must die."""

    name = "Killer"

    def condition(self) -> Column:
        raise NotImplementedError

    def message(self) -> str:
        return self.name

    def apply(self, df: DataFrame) -> DataFrame:
        return kill_if(with_state(df), self.condition(), self.name, self.message())


@dataclass
class Compare(Killer):
    """Kill where ``key`` stands in the relation to ``value``."""

    key: str
    value: object
    relation: str = "gt"

    RELATIONS = {
        "gt": lambda a, b: a > b,
        "ge": lambda a, b: a >= b,
        "lt": lambda a, b: a < b,
        "le": lambda a, b: a <= b,
        "eq": lambda a, b: a == b,
        "ne": lambda a, b: a != b,
    }

    @property
    def name(self):
        return f"Metadata{self.relation.upper()}"

    def condition(self):
        return F.coalesce(self.RELATIONS[self.relation](attribute(self.key), F.lit(self.value)), F.lit(False))

    def message(self):
        return f"{self.key} {self.relation} {self.value}"


def MetadataGT(key, value):
    return Compare(key, value, "gt")


def MetadataGE(key, value):
    return Compare(key, value, "ge")


def MetadataLT(key, value):
    return Compare(key, value, "lt")


def MetadataLE(key, value):
    return Compare(key, value, "le")


def MetadataEQ(key, value):
    return Compare(key, value, "eq")


def MetadataNE(key, value):
    return Compare(key, value, "ne")


@dataclass
class MetadataDefined(Killer):
    key: str
    name = "MetadataDefined"

    def condition(self):
        return attribute(self.key).isNotNull()

    def message(self):
        return f"{self.key} is defined"


@dataclass
class MetadataUndefined(Killer):
    key: str
    name = "MetadataUndefined"

    def condition(self):
        return attribute(self.key).isNull()

    def message(self):
        return f"{self.key} is undefined"


@dataclass
class MetadataInterval(Killer):
    """Kill outside (default) or inside a range whose edges are closed or open independently."""

    key: str
    lower: object
    upper: object
    use_lower_edge: bool = True
    use_upper_edge: bool = True
    kill_if_outside: bool = True
    name = "MetadataInterval"

    def condition(self):
        x = attribute(self.key)
        low = x >= F.lit(self.lower) if self.use_lower_edge else x > F.lit(self.lower)
        high = x <= F.lit(self.upper) if self.use_upper_edge else x < F.lit(self.upper)
        inside = low & high
        return F.coalesce(~inside if self.kill_if_outside else inside, F.lit(False))

    def message(self):
        return f"{self.key} {'outside' if self.kill_if_outside else 'inside'} [{self.lower}, {self.upper}]"


class FiringSquad(Killer):
    """Killers in order: a row dies by, and logs, the first whose test holds."""

    name = "FiringSquad"

    def __init__(self, killers: Sequence[Killer]):
        self.killers = list(killers)

    def __iadd__(self, other: Killer):
        self.killers.append(other)
        return self

    def condition(self):
        result = F.lit(False)
        for k in self.killers:
            result = result | k.condition()
        return result

    def first(self) -> Column:
        """Log record of the first test that holds; null if none does."""
        result = F.lit(None)
        for k in reversed(self.killers):
            result = F.when(k.condition(), log_entry(k.name, k.message())).otherwise(result)
        return result

    def apply(self, df):
        df = with_state(df)
        if not self.killers:
            return df
        hit = attribute(LIVE) & self.condition()
        return df.withColumns({LIVE: attribute(LIVE) & ~self.condition(), ELOG: F.when(hit, F.array_append(attribute(ELOG), self.first())).otherwise(attribute(ELOG))})


@dataclass
class ChangeKey:
    """Rename an attribute. Without it the row is unchanged and lives on."""

    old: str
    new: str
    erase_old: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        df = with_state(df)
        if self.old not in df.columns:
            return df
        present = attribute(LIVE) & attribute(self.old).isNotNull()
        before = attribute(self.new) if self.new in df.columns else F.lit(None)
        columns = {self.new: F.when(present, attribute(self.old)).otherwise(before)}
        if self.erase_old:
            columns[self.old] = F.when(attribute(LIVE), F.lit(None)).otherwise(attribute(self.old))
        return df.withColumns(columns)


@dataclass
class SetValue:
    key: str
    value: object

    def apply(self, df: DataFrame) -> DataFrame:
        df = with_state(df)
        before = attribute(self.key) if self.key in df.columns else F.lit(None)
        return df.withColumn(self.key, F.when(attribute(LIVE), F.lit(self.value)).otherwise(before))


def _floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("double")


def _modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor."""
    return a.cast("double") - b.cast("double") * _floor_divide(a, b)


ARITHMETIC = {
    "Add": lambda a, b: F.try_add(a, b),
    "Subtract": lambda a, b: F.try_subtract(a, b),
    "Multiply": lambda a, b: F.try_multiply(a, b),
    "Divide": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "IntegerDivide": _floor_divide,
    "Mod": _modulo,
}


class _Arithmetic:
    """result = operation(left, right); rows where an operand is missing or no number, or the
    result undefined, die. A missing operand is logged, the others are not."""

    def __init__(self, name: str, target: str, left: str, right: str | None, value=None):
        self.name, self.target, self.left, self.right, self.value = name, target, left, right, value

    def apply(self, df: DataFrame) -> DataFrame:
        df = with_state(df)
        operands = [self.left] + ([self.right] if self.right else [])
        if any(c not in df.columns for c in operands):
            return kill_if(df, F.lit(True), self.name, f"missing {', '.join(c for c in operands if c not in df.columns)}")
        kinds = [df.schema[c].dataType for c in operands]
        a, b = attribute(self.left), attribute(self.right) if self.right else F.lit(self.value)
        strings = all(isinstance(k, StringType) for k in kinds) and (self.right or isinstance(self.value, str))
        if self.name == "Add" and strings:
            result = F.concat(a, b)
        elif not all(isinstance(k, NumericType) for k in kinds) or not self.right and isinstance(self.value, str):
            return kill_if(df, F.lit(True), self.name, "bad type", log=False)
        else:
            result = ARITHMETIC[self.name](a, b)
        missing = F.lit(False)
        for c in operands:
            missing = missing | attribute(c).isNull()
        before = attribute(self.target) if self.target in df.columns else F.lit(None)
        fails = attribute(LIVE) & ~missing & result.isNull()
        return df.withColumns(
            {
                self.target: F.when(attribute(LIVE) & result.isNotNull(), result).otherwise(before),
                ELOG: F.when(attribute(LIVE) & missing, F.array_append(attribute(ELOG), log_entry(self.name, f"missing {' or '.join(operands)}"))).otherwise(attribute(ELOG)),
                LIVE: attribute(LIVE) & ~missing & ~fails,
            }
        )


def _one(name):
    return lambda key, value: _Arithmetic(name, key, key, None, value)


def _two(name):
    return lambda target, left, right: _Arithmetic(name, target, left, right)


Add, Subtract, Multiply, Divide, IntegerDivide, Mod = (_one(n) for n in ARITHMETIC)
Add2, Subtract2, Multiply2, Divide2, IntegerDivide2, Mod2 = (_two(n) for n in ARITHMETIC)


class MetadataOperatorChain:
    """Editors one after the other."""

    def __init__(self, editors: Sequence):
        self.editors = list(editors)

    def apply(self, df: DataFrame) -> DataFrame:
        for e in self.editors:
            df = e.apply(df)
        return df


def erase_metadata(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without these attributes; absent ones are no error, and dead rows lose them too."""
    return df.drop(*keys)


class Janitor:
    """Keeps a list of attributes; the others are dropped, returned, or moved into one map."""

    def __init__(self, keepers: Sequence[str]):
        self.keepers = list(keepers)

    def add2keepers(self, key: str) -> Janitor:
        if key not in self.keepers:
            self.keepers.append(key)
        return self

    def _trash(self, df: DataFrame) -> list[str]:
        kept = {*self.keepers, LIVE, ELOG}
        return [c for c in df.columns if c not in kept]

    def clean(self, df: DataFrame) -> DataFrame:
        return df.drop(*self._trash(df))

    def trash(self, df: DataFrame) -> Column:
        """The other attributes that are defined, as text by name."""
        names = self._trash(df)
        if not names:
            return F.create_map().cast("map<string,string>")
        whole = F.create_map(*[x for c in names for x in (F.lit(c), attribute(c).cast("string"))])
        return F.map_filter(whole, lambda _, v: v.isNotNull())

    def collect_trash(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.clean(df), df.select(self.trash(df).alias("trash"))

    def bag_trash(self, df: DataFrame, key: str = "trash") -> DataFrame:
        return df.withColumn(key, self.trash(df)).drop(*self._trash(df))


#: What a waveform index keeps besides its time base.
MINISEED_KEEPERS = ("net", "sta", "chan", "loc", "starttime", "endtime", "npts", "delta", "sampling_rate", "calib", "_id", "site_id", "channel_id", "source_id")


def MiniseedJanitor() -> Janitor:
    return Janitor(MINISEED_KEEPERS)


def geojson_point(lat: Column, lon: Column) -> Column:
    """A GeoJSON point of a position."""
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def fetch_bandwidth(df: DataFrame, low: str, high: str, into: tuple[str, str] = ("flow", "fhigh")) -> DataFrame:
    """The edges of the working band from two attributes, as numbers; -1 where one is absent, null or no number."""
    edge = lambda c: F.coalesce(attribute(c).try_cast("double"), F.lit(-1.0)) if c in df.columns else F.lit(-1.0)
    return df.withColumns({into[0]: edge(low), into[1]: edge(high)})


def validate_bandwidth(df: DataFrame, low: str, high: str, into: tuple[str, str] = ("flow", "fhigh")) -> DataFrame:
    """``fetch_bandwidth``; live data die, with a log entry, where an edge is missing or negative, or the
    high one is not above the low one."""
    df = fetch_bandwidth(with_state(df), low, high, into)
    a, b = attribute(into[0]), attribute(into[1])
    missing = F.array_join(F.array_compact(F.array(F.when(a < 0, F.lit(low)), F.when(b < 0, F.lit(high)))), ", ")
    text = F.when((a < 0) | (b < 0), F.concat(F.lit("no bandwidth under "), missing)).otherwise(F.concat(F.lit("invalid bandwidth: "), a.cast("string"), F.lit(" to "), b.cast("string")))
    return kill_if(df, (a < 0) | (b < 0) | (b <= a), "validate_bandwidth", text)
