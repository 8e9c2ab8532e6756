"""Problem 5: deeply nested records as related flat tables with parent links.

A bottom-up tree automaton with a fixed set of states runs over each parsed
record: a scalar is blank or a value, an array is blank, a list of values or
other, an object is blank, the parts of a date or other. Its last transition
takes an object of a kind to its structural variant: the kind with the form in
which each attribute is stored (a date as text or in parts, a degree under
either key), a blank or absent attribute fitting every form. So there are as
many variants as the grammar has combinations of forms, however many shapes
the objects have. Rows are routed by variant: the supertype table (record,
kind, child_path, parent_path, place, storage, variant, payload) is written
with one folder per variant, and each folder is read as the typed subtype
table of its own columns. Subtype tables share the supertype's keys, so they
unite to the table of a kind.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import materialize

BLANK, VALUE, LIST, PARTS, OTHER = "blank", "value", "list", "parts", "other"
DATE_PARTS = ("year", "month", "day")


@dataclass(frozen=True)
class Form:
    """One way to store an attribute: the key it stands under and the state its value has there."""

    tag: str
    key: str
    state: str = VALUE


@dataclass(frozen=True)
class Attribute:
    name: str
    forms: tuple[Form, ...]


def plain(name: str) -> Attribute:
    return Attribute(name, (Form("text", name),))


def date(name: str) -> Attribute:
    return Attribute(name, (Form("text", name), Form("parts", name, PARTS)))


@dataclass(frozen=True)
class Kind:
    """A kind of child: the fields that may hold its array (first that holds elements wins), its attributes and its own children."""

    name: str
    fields: tuple[str, ...]
    attributes: tuple[Attribute, ...] = ()
    children: tuple[Kind, ...] = field(default_factory=tuple)


PROJECT = Kind("project", ("projects",), (plain("name"), Attribute("stack", (Form("list", "stack", LIST), Form("text", "stack")))))
POSITION = Kind("position", ("positions",), (plain("title"), date("start_date"), plain("description")), (PROJECT,))
DEGREE = Attribute("degree", (Form("degree_name", "degree_name"), Form("degree", "degree")))
PROFILE_KINDS = (
    Kind(
        "experience",
        ("experiences", "experience"),
        (plain("title"), plain("company"), plain("description"), date("start_date"), date("end_date")),
        (POSITION,),
    ),
    Kind("education", ("education", "educations_details"), (plain("field_of_study"), DEGREE, plain("school"), plain("description"))),
    Kind("certification", ("certifications",), (plain("name"), plain("authority"))),
)


def _no_constant(name: str):
    raise ValueError(name)  # NaN and Infinity are no JSON


def parse(text: str | None):
    """The value of a JSON text, or None where there is none."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        try:
            return parse_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


TOKEN = re.compile(r"[ \t\n\r]*(?:([\[\]{},:\"])|(-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)|(true|false|null)|($))")
WORDS = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """``json.loads`` with a stack in place of recursion, for records nested deeper than the library reads."""
    whole: list = []
    stack: list = [whole]  # open containers, the outermost a list for the value itself
    keys: list = []  # the key that each open object waits with
    want, at = "value", 0
    while True:
        m = TOKEN.match(text, at)
        if m is None:
            raise ValueError(at)
        at = m.end()
        mark, number, fraction, exponent, word, end = m.groups()
        top = stack[-1]
        closes = mark in ("]", "}") and len(stack) > 1 and (mark == "}") == isinstance(top, dict)
        if closes and want in ("next", "first"):
            stack.pop()
            if mark == "}":
                keys.pop()
            want = "next"
        elif want == "next":
            if end is not None and top is whole:
                return whole[0]
            if mark != "," or top is whole:
                raise ValueError(at)
            want = "key" if isinstance(top, dict) else "value"
        elif want == "key" or want == "first" and isinstance(top, dict):
            if mark != '"':
                raise ValueError(at)
            keys[-1], at = scanstring(text, at, True)
            want = "colon"
        elif want == "colon":
            if mark != ":":
                raise ValueError(at)
            want = "value"
        else:
            want = "next"
            if mark == '"':
                value, at = scanstring(text, at, True)
            elif mark in ("[", "{"):
                value, want = ([] if mark == "[" else {}), "first"
            elif number is not None:
                value = float(m[0]) if fraction or exponent else int(number)
            elif word is not None:
                value = WORDS[word]
            else:
                raise ValueError(at)
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            if want == "first":
                stack.append(value)
                if mark == "{":
                    keys.append(None)


def write_json(value) -> str:
    """JSON text of a value, nested however deep; ASCII, so that every string can be stored."""
    try:
        return json.dumps(value)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list = [value]
    while stack:
        node = stack.pop()
        if isinstance(node, _Piece):
            out.append(node)
        elif isinstance(node, dict):
            stack.append(_Piece("}"))
            for i, (k, v) in reversed(list(enumerate(node.items()))):
                stack += [v, _Piece((", " if i else "") + json.dumps(k) + ": ")]
            stack.append(_Piece("{"))
        elif isinstance(node, list):
            stack.append(_Piece("]"))
            for i, v in reversed(list(enumerate(node))):
                stack.append(v)
                if i:
                    stack.append(_Piece(", "))
            stack.append(_Piece("["))
        else:
            out.append(json.dumps(node))
    return "".join(out)


class _Piece(str):
    """Text that is already JSON."""


class ShapeAutomaton:
    """Bottom-up states of JSON nodes, and the variants of objects of a kind. Transitions are kept by their inputs."""

    def __init__(self):
        self.variants: dict[tuple, tuple[str, tuple[str, ...]]] = {}

    @staticmethod
    def scalar(node) -> str:
        return BLANK if node is None or isinstance(node, str) and not node.strip() else VALUE

    @staticmethod
    def transition(node, below: list[str]) -> str:
        """The state of an array or object from those of its elements or values."""
        kinds = set(below)
        if kinds <= {BLANK}:
            return BLANK
        flat = kinds <= {BLANK, VALUE}
        if isinstance(node, list):
            return LIST if flat else OTHER
        return PARTS if flat and node.keys() <= set(DATE_PARTS) else OTHER

    def states(self, root) -> dict[int, str]:
        """The states of ``root`` and all arrays and objects below it, by id; a stack, so depth is no limit."""
        told: dict[int, str] = {}
        stack = [(root, False)]
        while stack:
            node, seen = stack.pop()
            below = node.values() if isinstance(node, dict) else node
            if seen:
                told[id(node)] = self.transition(node, [self.state(x, told) for x in below])
            else:
                stack.append((node, True))
                stack += [(x, False) for x in below if isinstance(x, (dict, list))]
        return told

    def state(self, node, told: dict[int, str]) -> str:
        return told[id(node)] if isinstance(node, (dict, list)) else self.scalar(node)

    def variant(self, kind: Kind, element: dict, told: dict[int, str]) -> tuple[str, tuple[str, ...]]:
        """(variant, keys typed by it) of an object of a kind."""
        inputs = [kind.name]
        for attribute in kind.attributes:
            for form in attribute.forms:
                inputs.append(self.state(element.get(form.key), told))
        known = self.variants.get(tuple(inputs))
        if known is None:
            known = self.variants[tuple(inputs)] = self._name(kind, inputs[1:])
        return known

    @staticmethod
    def _name(kind: Kind, states: list[str]) -> tuple[str, tuple[str, ...]]:
        tags, typed, given = [kind.name], [], iter(states)
        for attribute in kind.attributes:
            held = [(form, next(given)) for form in attribute.forms]
            fitting = [form for form, state in held if state == form.state]
            filled = any(state != BLANK for _, state in held)
            form = fitting[0] if fitting else None if filled else attribute.forms[0]
            if form is not None:
                typed.append(form.key)
            if form is None or len(attribute.forms) > 1:
                tags.append(f"{attribute.name}-{form.tag if form else OTHER}")
        return ".".join(tags), tuple(typed)


def elements(value) -> tuple[str, list]:
    """(storage, elements) of a field that should hold an array."""
    storage = "array"
    while isinstance(value, str):
        value, storage = parse(value), "encoded"
    if isinstance(value, list):
        return storage, value
    if isinstance(value, dict):
        if value and all(k.isascii() and k.isdigit() for k in value):
            return "numbered" if storage == "array" else storage, list(value.values())
        return "single" if storage == "array" else storage, [value]
    return "none", []


def children(node: dict, kinds: tuple[Kind, ...], path: str, automaton: ShapeAutomaton, told: dict[int, str]) -> Iterator[tuple]:
    """(kind, child_path, parent_path, place, storage, variant, payload, rest) of every object below ``node`` that is no blank."""
    for kind in kinds:
        storage, found = "none", []
        for name in kind.fields:
            storage, found = elements(node.get(name))
            if found:
                break
        if not found:
            continue
        nested = {f for k in kind.children for f in k.fields}
        for place, element in enumerate(found):
            if not isinstance(element, dict):
                continue
            states = told if id(element) in told else automaton.states(element)  # a decoded string has nodes of its own
            if states[id(element)] == BLANK:
                continue
            here = f"{path}/{kind.name}:{place}" if path else f"{kind.name}:{place}"
            variant, typed = automaton.variant(kind, element, states)
            own = {k: element[k] for k in typed if k in element}
            rest = {k: v for k, v in element.items() if k not in nested and k not in typed and automaton.state(v, states) != BLANK}
            yield kind.name, here, path or None, place, storage, variant, write_json(own), write_json(rest) if rest else None
            yield from children(element, kind.children, here, automaton, states)


NODE_FIELDS = (
    T.StructField("kind", T.StringType()),
    T.StructField("child_path", T.StringType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("place", T.IntegerType()),
    T.StructField("storage", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("rest", T.StringType()),
)


def flatten_records(df: DataFrame, record: str, text: str, kinds: tuple[Kind, ...] = PROFILE_KINDS) -> DataFrame:
    """The supertype table: one row per object of a kind, with its record's key, its parent's path and its variant.

    ``payload`` holds the attributes the variant types, ``rest`` all other
    fields that are not blank (null where there are none), both as JSON. Elements that are no
    objects, and objects whose scalars at every depth are null or white space,
    give no row but keep their place. A record that is no valid JSON object
    (also after decoding a JSON string) gives none; depth is no limit. Rows of
    one record key that repeat give repeated rows; null keys are kept. No
    shuffle: one pass over the rows.
    """
    schema = T.StructType([df.schema[record], *NODE_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShapeAutomaton()
        for batch in batches:
            rows, owners = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                node = parse(value)
                while isinstance(node, str):
                    node = parse(node)
                if not isinstance(node, dict):
                    continue
                found = list(children(node, kinds, "", automaton, automaton.states(node)))
                rows += found
                owners += [i] * len(found)
            columns = [batch.column(0).take(pa.array(owners, type=pa.int32()))]
            for at, f in enumerate(NODE_FIELDS):
                kind = pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()
                columns.append(pa.array([r[at] for r in rows], type=kind))
            yield pa.RecordBatch.from_arrays(columns, names=[record, *[f.name for f in NODE_FIELDS]])

    return df.select(F.col(f"`{record}`"), F.col(f"`{text}`").cast("string").alias("__json")).mapInArrow(run, schema)


MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _typed(attribute: Attribute, form: Form) -> tuple[str, list[Column]]:
    """(the field's type in the payload, the columns made of it) of an attribute in one form."""
    value = F.col(f"p.`{form.key}`")
    if form.state == PARTS:
        parts = [value[part].try_cast("int").alias(f"{attribute.name}_{part}") for part in DATE_PARTS]
        return "struct<year string, month string, day string>", parts
    if form.state == LIST:
        return "array<string>", [value.alias(attribute.name)]
    if len(attribute.forms) > 1 and any(f.state == PARTS for f in attribute.forms):
        text = F.nullif(F.trim(value), F.lit(""))
        year = F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)", 1)
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(text, 1, 3)).cast("int")
        month = F.coalesce(F.regexp_extract(text, r"^[0-9]{4}-([0-9]{2})", 1).try_cast("int"), F.nullif(named, F.lit(0)))
        return "string", [
            text.alias(f"{attribute.name}_text"),
            year.try_cast("int").alias(f"{attribute.name}_year"),
            month.alias(f"{attribute.name}_month"),
        ]
    beside_list = any(f.state == LIST for f in attribute.forms)
    return "string", [value.alias(f"{attribute.name}_text" if beside_list else attribute.name)]


def grammar(kinds: tuple[Kind, ...]) -> dict[str, Kind]:
    """All kinds by name, nested ones too."""
    out: dict[str, Kind] = {}
    for kind in kinds:
        out |= {kind.name: kind} | grammar(kind.children)
    return out


def subtype_table(rows: DataFrame, kind: Kind, variant: str, record: str) -> DataFrame:
    """The typed table of one variant: the supertype's keys, then the columns of its forms and the ``rest``."""
    tags = {part.split("-", 1)[0]: part.split("-", 1)[1] for part in variant.split(".")[1:]}
    fields, columns = [], []
    for attribute in kind.attributes:
        tag = tags.get(attribute.name, attribute.forms[0].tag)
        form = next((f for f in attribute.forms if f.tag == tag), None)
        if form is None:
            continue
        kind_of, made = _typed(attribute, form)
        fields.append(f"`{form.key}` {kind_of}")
        columns += made
        if len({f.key for f in attribute.forms}) > 1:
            columns.append(F.when(F.col(f"p.`{form.key}`").isNotNull(), F.lit(form.key)).alias(f"{attribute.name}_field"))
    keys = [F.col(f"`{record}`"), F.col("child_path"), F.col("parent_path"), F.col("place"), F.col("storage"), F.lit(variant).alias("variant")]
    if not fields:
        return rows.select(*keys, "rest")
    return rows.withColumn("p", F.from_json("payload", ", ".join(fields))).select(*keys, *columns, "rest")


class VariantTables:
    """The supertype table, written once with a folder per variant; ``tables`` are the subtype tables by kind and variant."""

    def __init__(self, nodes: DataFrame, record: str, kinds: tuple[Kind, ...] = PROFILE_KINDS):
        self.record, self.kinds = record, grammar(kinds)
        self.nodes = materialize(nodes, "variants", partition_by=("kind", "variant"))
        found = self.nodes.select("kind", "variant").distinct().collect()  # as many as the grammar has forms
        self.tables: dict[str, dict[str, DataFrame]] = {name: {} for name in self.kinds}
        for kind, variant in sorted(map(tuple, found)):
            rows = self.nodes.filter((F.col("kind") == kind) & (F.col("variant") == variant))
            self.tables[kind][variant] = subtype_table(rows, self.kinds[kind], variant, record)

    def keys(self) -> DataFrame:
        """Record, kind and child_path of all objects, from their subtype tables."""
        parts = [t.select(self.record, F.lit(kind).alias("kind"), "child_path") for kind, own in self.tables.items() for t in own.values()]
        if not parts:
            return self.nodes.select(self.record, "kind", "child_path")
        return reduce(DataFrame.unionAll, parts)

    def kind(self, name: str) -> DataFrame:
        """The subtype tables of a kind as one; a column that a variant lacks is null there."""
        own = list(self.tables[name].values())
        kind = self.kinds[name]
        empty = self.nodes.filter("false")
        bare = [subtype_table(empty, kind, ".".join([name, *tags]), self.record) for tags in _forms(kind)]  # the kind's columns, whatever is there
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*bare, *own])


def _forms(kind: Kind) -> list[list[str]]:
    """Tags of variants that between them have every form of every attribute."""
    most = max((len(a.forms) for a in kind.attributes), default=1)
    return [[f"{a.name}-{a.forms[min(i, len(a.forms) - 1)].tag}" for a in kind.attributes if len(a.forms) > 1] for i in range(most)]


def profile_nodes(spark, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/raw_profiles.parquet").select("raw_id", "profile_data")
    return flatten_records(raw, "raw_id", "profile_data")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return VariantTables(profile_nodes(spark, sf_dir), "raw_id").keys().distinct()


def p5_table(kind: str):
    def query(spark, sf_dir: str) -> DataFrame:
        return VariantTables(profile_nodes(spark, sf_dir), "raw_id").kind(kind).distinct()

    return query


def p5_shapes(spark, sf_dir: str) -> DataFrame:
    """How many objects each structural variant has."""
    return profile_nodes(spark, sf_dir).groupBy("kind", "storage", "variant").agg(F.count("*").alias("objects"))
