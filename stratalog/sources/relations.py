"""What patterns scan: mapped tables, triple tables, parsed graphs, and derived facts."""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.operators.slots import double_text, key_of, typed_prefix
from stratalog.terms import IRI, Triple, key

KEYS = "s string, p string, o string"


@dataclass
class Relation:
    """Triples of one predicate: df has columns s and o of these kinds."""

    frame: DataFrame | None
    s_kind: str
    o_kind: str
    #: For mapped tables: the table's name and DataFrame, and the object's column; such scans can be fused.
    table: str | None = None
    rows: DataFrame | None = None
    subject: Column | None = None
    object: Column | None = None
    #: Whether no two rows of the table have one subject.
    unique: bool = True
    #: Whether the frame is a written table; others are computed whenever they are read.
    stored: bool = False

    @property
    def df(self) -> DataFrame:
        """Built when asked for: most columns of a mapped table are never read by a program."""
        if self.frame is None:
            rows = self.rows.where(self.subject.isNotNull() & self.object.isNotNull())
            self.frame = rows.select(self.subject.alias("s"), self.object.alias("o"))
            if not self.unique:
                self.frame = self.frame.distinct()
        return self.frame

    def keyed(self) -> DataFrame:
        return self.df.select(key_of(self.s_kind, F.col("s")).alias("s"), key_of(self.o_kind, F.col("o")).alias("o"))


def kind_of(t: T.DataType) -> str | None:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, T.DoubleType):
        return "double"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "dateTime" if isinstance(t, T.TimestampNTZType) else None


def native_or_key(t: T.DataType, c: Column) -> tuple[str, Column] | None:
    """The slot kind and value of a mapped column: native where slots have such a kind, else by key; None for nested types."""
    kind = kind_of(t)
    if kind is not None:
        return kind, c.cast("bigint") if kind == "integer" else c
    if isinstance(t, T.FloatType):
        name, text = "float", double_text(c.cast("double"))
    elif isinstance(t, T.DecimalType):
        name, text = "decimal", c.cast("string")
    elif isinstance(t, T.DateType):
        name, text = "date", c.cast("string")
    elif isinstance(t, T.TimestampType):
        seconds = (F.unix_micros(c).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
        utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
        name, text = "dateTime", F.concat(F.regexp_replace(utc.cast("string"), " ", "T"), F.lit("Z"))
    elif isinstance(t, T.BinaryType):
        name, text = "base64Binary", F.base64(c)
    else:
        return None
    return "key", F.concat(F.lit(typed_prefix(name)), text)


@dataclass
class Mapping:
    """A table as triples: subject <subject_prefix><key>, one predicate <column_prefix><column> for each column.

    links: column -> subject prefix of the table it refers to; they give predicates <link_prefix><column>.
    The key is unique, or else unique is False and equal rows count once: triples are a set. A key of several columns or
    none is hashed from the row by the caller. Columns of nested types have no terms and are named in leave_out.
    """

    name: str
    df: DataFrame
    key: str
    links: dict[str, str] = field(default_factory=dict)
    subject_prefix: str = ""
    column_prefix: str = "urn:c:"
    link_prefix: str = "urn:fk:"
    unique: bool = True
    leave_out: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.subject_prefix = self.subject_prefix or f"urn:t:{self.name}:"


class Source:
    """Relations by predicate, and triples of any predicate as keys."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.by_predicate: dict[str, list[Relation]] = {}
        self.local: list[Triple] = []
        self.tables: list[DataFrame] = []  # s, p, o keys
        self._local_df: DataFrame | None = None

    def add_mapping(self, m: Mapping) -> None:
        ref = "ref:" + m.subject_prefix
        subject = F.col(f"`{m.key}`")
        for f in m.df.schema.fields:
            if f.name in m.leave_out:
                continue
            c = F.col(f"`{f.name}`")
            mapped = native_or_key(f.dataType, c)
            if mapped is None:
                raise ValueError(f"column {f.name} of table {m.name} is of type {f.dataType.simpleString()}, which has no terms; name it in leave_out")
            put = lambda predicate, kind, value: self.by_predicate.setdefault(predicate, []).append(Relation(None, ref, kind, m.name, m.df, subject, value, m.unique))
            put(m.column_prefix + f.name, *mapped)
            if f.name in m.links:
                put(m.link_prefix + f.name, "ref:" + m.links[f.name], c.cast("bigint") if mapped[0] == "integer" else c)

    def add_triples(self, triples: Iterable[Triple]) -> None:
        self.local += triples
        self._local_df = None

    def add_table(self, df: DataFrame) -> None:
        """A table of term keys (s, p, o)."""
        self.tables.append(df.select("s", "p", "o"))

    def local_df(self) -> DataFrame:
        if self._local_df is None:
            rows = list(dict.fromkeys((key(s), key(p), key(o)) for s, p, o in self.local))
            self._local_df = self.spark.createDataFrame(rows, KEYS)
        return self._local_df

    def of(self, predicate: IRI) -> list[Relation]:
        k = key(predicate)
        found = list(self.by_predicate.get(predicate.value, ()))
        for df in self.tables:
            found.append(Relation(df.where(F.col("p") == k).select("s", "o"), "key", "key"))
        if any(p == predicate for _, p, _ in self.local):
            found.append(Relation(self.local_df().where(F.col("p") == k).select("s", "o"), "key", "key"))
        return found

    def everything(self) -> DataFrame:
        """All triples as keys."""
        parts = [self.local_df(), *self.tables]
        for p, rels in self.by_predicate.items():
            parts += [r.keyed().select("s", F.lit("I" + p).alias("p"), "o") for r in rels]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.distinct() if len(self.tables) + bool(self.local) > 1 or (self.by_predicate and (self.tables or self.local)) else out
