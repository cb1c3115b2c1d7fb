"""Tables and their attributes: types, constraints, aliases and references, and what checks them.

A schema is a mapping of tables to attributes (a dict of type, constraint, aliases, reference,
readonly), as a YAML or JSON document has it. The three modes: ``promiscuous`` checks nothing,
``cautious`` casts and kills only for required attributes, ``pedantic`` kills on any mismatch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quakeframe.state import LIVE, log_if, with_state

TYPES = {"int": "long", "integer": "long", "float": "double", "double": "double", "str": "string", "string": "string", "bool": "boolean", "boolean": "boolean", "list": "array<string>", "dict": "map<string,string>", "objectid": "string", "bytes": "binary"}
CONSTRAINTS = ("required", "xref_key", "normal", "optional")
MODES = ("promiscuous", "cautious", "pedantic")


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "string"
    constraint: str = "normal"
    aliases: tuple[str, ...] = ()
    reference: str | None = None
    readonly: bool = False

    def __post_init__(self):
        if self.type.lower() not in TYPES:
            raise ValueError(f"{self.name}: unknown type {self.type}")
        if self.constraint not in CONSTRAINTS:
            raise ValueError(f"{self.name}: unknown constraint {self.constraint}")

    @property
    def spark(self) -> str:
        return TYPES[self.type.lower()]


@dataclass
class TableSchema:
    name: str
    attributes: dict[str, Attribute] = field(default_factory=dict)

    def keys(self) -> list[str]:
        return list(self.attributes)

    def required_keys(self) -> list[str]:
        return [a.name for a in self.attributes.values() if a.constraint == "required"]

    def xref_keys(self) -> list[str]:
        return [a.name for a in self.attributes.values() if a.constraint == "xref_key"]

    def aliases(self, key: str) -> tuple[str, ...]:
        return self.attributes[key].aliases

    def is_alias(self, name: str) -> bool:
        return any(name in a.aliases for a in self.attributes.values())

    def unique_name(self, name: str) -> str:
        """The definitive name of an attribute or alias."""
        if name in self.attributes:
            return name
        for a in self.attributes.values():
            if name in a.aliases:
                return a.name
        raise KeyError(name)

    def type(self, key: str) -> str:
        return self.attributes[key].spark

    def reference(self, key: str) -> str:
        return self.attributes[key].reference or self.name

    def readonly(self, key: str) -> bool:
        return self.attributes[key].readonly

    def add_alias(self, key: str, alias: str) -> None:
        a = self.attributes[key]
        self.attributes[key] = Attribute(a.name, a.type, a.constraint, (*a.aliases, alias), a.reference, a.readonly)

    def set_readonly(self, key: str, value: bool = True) -> None:
        a = self.attributes[key]
        self.attributes[key] = Attribute(a.name, a.type, a.constraint, a.aliases, a.reference, value)

    def swap_reference(self, old: str, new: str, database: Mapping[str, TableSchema] | None = None) -> None:
        """Attributes of table ``old`` become those of ``new``; with a database schema their types and
        constraints are those that it has there. Aliases and the readonly mark stay."""
        for key, a in self.attributes.items():
            if a.reference != old:
                continue
            there = database[new].attributes if database else {}
            like = there.get(key, there.get(key.removeprefix(f"{new}_").removeprefix(f"{old}_"), a))
            self.attributes[key] = Attribute(key, like.type, like.constraint, a.aliases, new, a.readonly)

    def struct(self) -> StructType:
        """As a Spark schema, with the constraints in the fields' metadata."""
        fields = []
        for a in self.attributes.values():
            about = {"constraint": a.constraint, "aliases": list(a.aliases), "reference": a.reference or "", "readonly": a.readonly}
            fields.append(StructField(a.name, _parse_datatype_string(a.spark), a.constraint != "required", about))
        return StructType(fields)

    # renaming -----------------------------------------------------------------------------------

    def apply_aliases(self, df: DataFrame, names: Mapping[str, str]) -> DataFrame:
        """Rename attributes to given aliases."""
        return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})

    def clear_aliases(self, df: DataFrame) -> DataFrame:
        """Definitive names; where both names are there the definitive one's value wins."""
        for a in self.attributes.values():
            for alias in a.aliases:
                if alias in df.columns:
                    df = df.withColumn(a.name, F.coalesce(a.name, alias)).drop(alias) if a.name in df.columns else df.withColumnRenamed(alias, a.name)
        return df


def table_schema(name: str, spec: Mapping[str, Mapping]) -> TableSchema:
    out = TableSchema(name)
    for key, about in spec.items():
        out.attributes[key] = Attribute(key, about.get("type", "string"), about.get("constraint", "normal"), tuple(about.get("aliases", ())), about.get("reference"), bool(about.get("readonly", False)))
    return out


def database_schema(spec: Mapping[str, Mapping[str, Mapping]]) -> dict[str, TableSchema]:
    """All tables; a table with ``base`` takes the attributes of another first."""
    out: dict[str, TableSchema] = {}
    for name, table in spec.items():
        own = dict(table.get("schema", table))
        base = table.get("base")
        out[name] = table_schema(name, {**({k: vars(a) for k, a in out[base].attributes.items()} if base else {}), **own})
    return out


def check_format(spec: Mapping) -> list[str]:
    """What is wrong with a specification of tables ({table: {"base", "schema": {attribute: {...}}}}); nothing if empty."""
    out: list[str] = []
    for name, table in spec.items():
        if not isinstance(table, Mapping):
            out.append(f"{name}: no mapping")
            continue
        seen, base = {name}, table.get("base")
        while base is not None:
            if base not in spec:
                out.append(f"{name}: unknown base {base}")
                break
            if base in seen:
                out.append(f"{name}: its base leads back to it")
                break
            seen.add(base)
            base = spec[base].get("base") if isinstance(spec[base], Mapping) else None
        own, names = table.get("schema", {} if "base" in table else table), {}
        for key, about in own.items() if isinstance(own, Mapping) else []:
            where = f"{name}.{key}"
            if not isinstance(about, Mapping):
                out.append(f"{where}: no mapping")
                continue
            if str(about.get("type", "string")).lower() not in TYPES:
                out.append(f"{where}: unknown type {about.get('type')}")
            if about.get("constraint", "normal") not in CONSTRAINTS:
                out.append(f"{where}: unknown constraint {about.get('constraint')}")
            if about.get("reference") is not None and about["reference"] not in spec:
                out.append(f"{where}: unknown reference {about['reference']}")
            aliases = about.get("aliases", ())
            if isinstance(aliases, str) or not all(isinstance(a, str) for a in aliases):
                out.append(f"{where}: aliases are no list of names")
                continue
            for a in (key, *aliases):
                if names.setdefault(a, key) != key:
                    out.append(f"{where}: {a} names {names[a]}, too")
    return out


def conform(df: DataFrame, schema: TableSchema, mode: str = "promiscuous", exclude: Sequence[str] = (), joined: Sequence[str] = ("site", "channel", "source"), drop_undefined: bool | None = None, modified: Sequence[str] = ()) -> DataFrame:
    """Rows as the table wants them, for a save or after a load.

    Aliases become definitive names, blank strings nulls; ``_id``-less joined columns and excluded
    ones go; readonly attributes that were modified are renamed with READONLYERROR_. Then the mode:
    casts, kills and logs. Without ``promiscuous`` undefined columns are dropped.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    df = with_state(schema.clear_aliases(df))
    gone = [c for c in df.columns if c in exclude or any(c.startswith(f"{p}_") and c != f"{p}_id" and c not in schema.attributes for p in joined)]
    df = df.drop(*gone)
    for c, kind in df.dtypes:
        if kind == "string":
            df = df.withColumn(c, F.when(F.trim(c) != "", F.col(c)))
    for c in modified:
        if c in df.columns and c in schema.attributes and schema.readonly(c):
            df = df.withColumnRenamed(c, f"READONLYERROR_{c}")
    if mode == "promiscuous":
        return df
    for a in schema.attributes.values():
        if a.name not in df.columns:
            if a.constraint == "required":
                df = df.withColumn("elog", log_if(F.col(LIVE), schema.name, f"{a.name} is missing")).withColumn(LIVE, F.lit(False))
            continue
        bad = mismatch(df, a)
        needs = a.constraint == "required"
        fatal = bad if mode == "pedantic" or needs else F.lit(False)
        if needs:
            fatal = fatal | F.col(a.name).isNull()
        df = df.withColumn("qf_bad", fatal & F.col(LIVE)).withColumn("elog", log_if(F.col("qf_bad"), schema.name, f"{a.name} has no valid value"))
        df = df.withColumns({LIVE: F.col(LIVE) & ~F.col("qf_bad"), a.name: F.col(a.name).try_cast(a.spark)}).drop("qf_bad")
    if drop_undefined is not False:
        df = df.drop(*[c for c in df.columns if c not in schema.attributes and c not in (LIVE, "elog")])
    return df


def mismatch(df: DataFrame, a: Attribute) -> Column:
    """Whether a defined value is not of the attribute's type and no cast makes it so."""
    kind = dict(df.dtypes)[a.name]
    same = kind == a.spark or {kind, a.spark} <= {"bigint", "long"}
    return F.lit(False) if same else F.col(a.name).isNotNull() & F.col(a.name).try_cast(a.spark).isNull()
