"""DuckDB SQL for the results of the queries of this subpackage."""

LEAKS = r"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), b as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), wins as (
    select distinct cast(item_id as varchar) as item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win
    from (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct n from wins),
placed as (
    select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as win
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d join sizes on len(w) >= n)
), hits as (
    select doc_id, item_id, placed.n, i from placed join wins on placed.win = wins.win and placed.n = wins.n
), words as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), items as (
    select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
    from (select distinct doc_id, item_id from hits) group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

CHATS = r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
    select *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') as safe,
        replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B') as code
    from t
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(code) + 1 + length(safe) + case when role = 'assistant' then 7 else 16 end) as bigint) as formatted_chars
from e group by conv_id
"""

# Pairs are counted on all common shingles; components by walking the links.
NEAR = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as ws from documents
), s as (
    select distinct doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as sh
    from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all
), links as (
    select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)
), reach(a, b) as (
    select doc_id, doc_id from w
    union select r.a, l.b from reach r join links l on l.a = r.b
), c as (select a as doc_id, min(b) as component_id from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from w left join n using (doc_id) join c using (doc_id)
"""


def _merkle(levels: int = 14) -> str:
    """One step a level, as many as 8^14 leaves need; a tree that has come down
    to one node passes it on. The checksum is worked out bit by bit."""

    def field(name: str) -> str:
        return f"coalesce(cast(octet_length(encode(cast({name} as varchar))) as varchar) || ':' || cast({name} as varchar), '-')"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    others = [field(f) for f in ("doc_id", "source", "lang", "n_chars")]
    byte = "list_reduce(list_prepend(xor(c, ascii(x)), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, x: {byte.replace('ascii(x)', 'x')}), 4294967295)"
    steps = [
        f"""l as (
    select row_number() over (order by lang nulls first, doc_id nulls first, leaf) as row, *,
        row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i0
    from (select doc_id, lang, sha256({' || '.join([*others, field('text')])}) as leaf,
        case when {crc} % 3 = 0 and text is not null then sha256({' || '.join([*others, field(lower)])}) end as shown from documents)
)""",
        "a0 as (select lang as g, i0 as i, leaf as d, count(*) over (partition by lang) as n from l)",
    ]

    def grow(name: str, k: int) -> str:
        return f"""{name}{k + 1} as (
    select g, i, case when m = 1 then ds[1] else sha256(array_to_string(ds, '')) end as d, count(*) over (partition by g) as n, m, ds
    from (select g, i // 8 as i, max(n) as m, list(d order by i) as ds from {name}{k} group by g, i // 8)
)"""

    steps += [grow("a", k) for k in range(levels)]
    steps.append(f"b0 as (select 0 as g, row_number() over (order by g nulls first) - 1 as i, d, count(*) over () as n, g as lang from a{levels})")
    steps += [grow("b", k) for k in range(levels)]
    steps.append(
        f"""p0 as (
    select l.*, b0.i as j0, b0.d as subroot, b{levels}.d as root, '' as proof, coalesce(shown, leaf) as h
    from l join b0 on l.lang is not distinct from b0.lang cross join b{levels}
)"""
    )
    for k in range(2 * levels):
        name, at, on, place = ("a", k, "t.g is not distinct from p.lang", "i0") if k < levels else ("b", k - levels, "true", "j0")
        node = f"(p.{place} // {8**at})"
        left, right = f"array_to_string(ds[:{node} % 8], '')", f"array_to_string(ds[{node} % 8 + 2:], '')"
        steps.append(
            f"""p{k + 1} as (
    select p.* exclude (proof, h), proof || case when m = 1 then '' else {left} || {right} end as proof,
        case when m = 1 then h else sha256({left} || h || {right}) end as h
    from p{k} p join {name}{at + 1} t on {on} and t.i = p.{place} // {8 ** (at + 1)}
)"""
        )
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from p{2 * levels}"


MERKLE = _merkle()
