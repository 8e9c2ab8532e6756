"""SQL for DuckDB of the flat tables of nested profiles."""

from __future__ import annotations

from plumbline.operators.nested_records import MONTHS, PARTS, PROFILE_KINDS, Attribute, Kind, grammar


def _decoded(j: str, times: int = 3) -> str:
    """A value with JSON strings replaced by what they hold."""
    for _ in range(times):
        inner = f"json_extract_string({j}, '$')"
        j = f"(case when json_type({j}) = 'VARCHAR' then case when json_valid({inner}) then {inner}::json end else {j} end)"
    return j


def _elements(j: str) -> str:
    numbered = f"len(json_keys({j})) > 0 and len(list_filter(json_keys({j}), lambda k: not regexp_full_match(k, '[0-9]+'))) = 0"
    return (
        f"(case json_type({j}) when 'ARRAY' then json_extract({j}, '$[*]')"
        f" when 'OBJECT' then case when {numbered} then json_extract({j}, '$.*') else [{j}] end else [] end)"
    )


_VALUE = "json_type(v) not in ('OBJECT', 'ARRAY', 'NULL') and not (json_type(v) = 'VARCHAR' and trim(regexp_replace(json_extract_string(v, '$'), '\\s', '', 'g')) = '')"


def _level(kind: Kind, source: str, prefix: str) -> str:
    """Objects of a kind below those of ``source`` (raw_id, path, j)."""
    fields = []
    for i, name in enumerate(kind.fields):
        fields.append(f"{_decoded(f'(j->{chr(39)}{name}{chr(39)})')} as f{i}, json_type((j->'{name}')) as t{i}")
    picked = " ".join(f"when len(e{i}) > 0 then e{i}" for i in range(len(kind.fields)))
    stored = []
    for i in range(len(kind.fields)):
        stored.append(
            f"when len(e{i}) > 0 then case when t{i} = 'VARCHAR' then 'encoded' when t{i} = 'ARRAY' then 'array'"
            f" when len(list_filter(json_keys(f{i}), lambda k: not regexp_full_match(k, '[0-9]+'))) = 0 then 'numbered' else 'single' end"
        )
    listed = ", ".join(f"{_elements(f'f{i}')} as e{i}" for i in range(len(kind.fields)))
    return f"""select raw_id, '{kind.name}' as kind, {prefix}'{kind.name}:' || (n - 1) as path, nullif(parent, '') as parent_path, (n - 1)::int as place, storage, j
from (select raw_id, parent, storage, l[n] as j, n from (select raw_id, parent, storage, l, unnest(range(1, len(l) + 1)) as n
  from (select *, case {picked} else [] end as l, case {' '.join(stored)} end as storage
    from (select *, {listed} from (select raw_id, path as parent, {', '.join(fields)} from {source})))))
where json_type(j) = 'OBJECT' and len(list_filter(json_extract(j, '$..*'), lambda v: {_VALUE})) > 0"""


def _nodes() -> str:
    parts = [
        f"r as (select distinct raw_id, '' as path, j from (select raw_id, {_decoded('p')} as j from (select raw_id, case when json_valid(profile_data) then profile_data::json end as p from raw_profiles)) where json_type(j) = 'OBJECT')"
    ]

    def below(kinds: tuple[Kind, ...], source: str, prefix: str) -> None:
        for kind in kinds:
            parts.append(f"{kind.name}_rows as ({_level(kind, source, prefix)})")
            below(kind.children, f"{kind.name}_rows", "parent || '/' || ")

    below(PROFILE_KINDS, "r", "")
    return "with " + ",\n".join(parts) + "\n"


NODES = _nodes()


def _kind_of(key: str) -> str:
    """The state of a value: blank, value, list, parts or other."""
    v = f"(j->'{key}')"
    inside = f"list_filter(json_extract({v}, '$..*'), lambda v: {_VALUE})"
    nested = f"len(list_filter(json_extract({v}, '$.*') || json_extract({v}, '$[*]'), lambda v: json_type(v) in ('OBJECT', 'ARRAY') and len(list_filter(json_extract(v, '$..*'), lambda v: {_VALUE})) > 0)) > 0"
    return (
        f"case when {v} is null or json_type({v}) = 'NULL' or json_type({v}) = 'VARCHAR' and trim(regexp_replace(json_extract_string({v}, '$'), '\\s', '', 'g')) = '' then 'blank'"
        f" when json_type({v}) not in ('OBJECT', 'ARRAY') then 'value' when len({inside}) = 0 then 'blank' when {nested} then 'other' when json_type({v}) = 'ARRAY' then 'list'"
        f" when len(list_filter(json_keys({v}), lambda k: k not in ('year', 'month', 'day'))) = 0 then 'parts' else 'other' end"
    )


def _form(a: Attribute) -> str:
    """Which form an attribute is stored in."""
    tests = " ".join(f"when ({_kind_of(f.key)}) = '{f.state}' then '{f.tag}'" for f in a.forms)
    filled = " or ".join(f"({_kind_of(f.key)}) <> 'blank'" for f in a.forms)
    return f"case {tests} when {filled} then 'other' else '{a.forms[0].tag}' end"


def _columns(a: Attribute) -> list[str]:
    text = next((f for f in a.forms if f.state == "value"), None)
    name = f"form_{a.name}"
    if any(f.state == PARTS for f in a.forms):
        raw = f"case when {name} = 'text' then nullif(trim((j->>'{text.key}')), '') end"
        at = f"list_position({MONTHS}, substring({raw}, 1, 3))"
        return [
            f"{raw} as {a.name}_text",
            f"case when {name} = 'parts' then try_cast((j->'{text.key}'->>'year') as int) else try_cast(nullif(regexp_extract({raw}, '(?:^|[^0-9])([0-9]{{4}})(?:[^0-9]|$)', 1), '') as int) end as {a.name}_year",
            f"case when {name} = 'parts' then try_cast((j->'{text.key}'->>'month') as int) else coalesce(try_cast(nullif(regexp_extract({raw}, '^[0-9]{{4}}-([0-9]{{2}})', 1), '') as int), nullif({at}, 0)) end::int as {a.name}_month",
            f"case when {name} = 'parts' then try_cast((j->'{text.key}'->>'day') as int) end as {a.name}_day",
        ]
    if any(f.state == "list" for f in a.forms):
        key = a.forms[0].key
        return [f"case when {name} = 'list' and json_type((j->'{key}')) = 'ARRAY' then list_transform(json_extract(j, '$.{key}[*]'), lambda v: json_extract_string(v, '$')) end as {a.name}", f"case when {name} = 'text' then (j->>'{key}') end as {a.name}_text"]
    cases = " ".join(f"when '{f.tag}' then (j->>'{f.key}')" for f in a.forms)
    out = [f"case {name} {cases} end as {a.name}"]
    if len({f.key for f in a.forms}) > 1:
        out.append("case " + " ".join(f"when {name} = '{f.tag}' and (j->>'{f.key}') is not null then '{f.key}'" for f in a.forms) + f" end as {a.name}_field")
    return out


def _variant(name: str, kind: Kind) -> str:
    tags = [f"'{name}'"]
    for a in kind.attributes:
        tag = f"'.{a.name}-' || form_{a.name}"
        tags.append(tag if len(a.forms) > 1 else f"case when form_{a.name} = 'other' then {tag} else '' end")
    return " || ".join(tags)


def table_sql(name: str) -> str:
    kind = grammar(PROFILE_KINDS)[name]
    forms = ", ".join(f"{_form(a)} as form_{a.name}" for a in kind.attributes)
    columns = [c for a in kind.attributes for c in _columns(a)]
    return NODES + f"""select distinct raw_id, path as child_path, parent_path, place, storage, {_variant(name, kind)} as variant, {', '.join(columns)}, null::varchar as rest
from (select *, {forms} from {name}_rows)"""


ALL = " union all ".join(f"select raw_id, kind, path as child_path, storage, j from {name}_rows" for name in grammar(PROFILE_KINDS))


def found_sql() -> str:
    return NODES + f"select distinct raw_id, kind, child_path from ({ALL})"


def shapes_sql() -> str:
    """Objects by kind, storage and variant; as in the plan, repeated rows count each time."""
    parts = []
    for name, kind in grammar(PROFILE_KINDS).items():
        forms = ", ".join(f"{_form(a)} as form_{a.name}" for a in kind.attributes)
        parts.append(f"select '{name}' as kind, storage, {_variant(name, kind)} as variant from (select *, {forms} from {name}_rows)")
    every = NODES.replace("select distinct raw_id, '' as path", "select raw_id, '' as path")
    return every + f"select kind, storage, variant, count(*) as objects from ({' union all '.join(parts)}) group by all"
