"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import oracle as licenses
from .secrets import ALLOW, CLASSES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The smallest node that edges e(a, b) of nodes v(n) reach.
_REACH = """
    ends as (select a, b from e union select b, a from e),
    reach(n, r) as (select n, n from v union select reach.n, ends.b from reach join ends on ends.a = reach.r),
    comp as (select n, min(r) as c from reach group by 1)"""


def _cut(pattern: str) -> str:
    return f"string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"


def _matches(source: str, kind: str, pattern: str, good: str) -> str:
    """Rows doc_id, kind, s, e, m of the good matches of a pattern."""
    return f"""select doc_id, '{kind}' as kind, cast(coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) as bigint) as s, length(parts[i]) as n, parts[i] as m
        from (select doc_id, {_cut(pattern)} as parts from {source}) q, unnest(range(2, len(parts) + 1, 2)) t(i) where {good}"""


def secrets() -> str:
    key = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
    base = [
        _matches("d", "assign", key + r"[A-Za-z0-9+/_.=-]+", f"regexp_matches(parts[i], '^{key}[A-Za-z0-9+/_.=-]{{6}}')"),
        _matches("d", "access", "AKIA[A-Z0-9]+", "length(parts[i]) >= 20"),
        _matches("d", "hex", "[0-9a-f]+", "length(parts[i]) >= 24"),
    ]
    allow = ALLOW.replace("'", "''")
    more = []
    for c in CLASSES:
        must = "true" if c.kind == "hex-entropy" else "regexp_matches(parts[i], '[a-z]') and regexp_matches(parts[i], '[A-Z]')"
        must = f"regexp_matches(parts[i], '[0-9]') and {'regexp_matches(parts[i], ' + chr(39) + '[a-fA-F]' + chr(39) + ')' if c.kind == 'hex-entropy' else must}"
        found = _matches("d", c.kind, c.pattern, f"{must} and not regexp_matches(parts[i], '{allow}')")
        more.append(f"""select doc_id, kind, s + min(k) - 1 as s, max(k) - min(k) + {c.window} as n, '' as m from (
            select *, sum(case when k - before <= {c.window} then 0 else 1 end) over (partition by doc_id, s order by k) as run from (
                select *, lag(k, 1, -1000000) over (partition by doc_id, s order by k) as before from (
                    select doc_id, kind, s, k, sum(-(c / {c.window}.0) * log2(c / {c.window}.0)) as h from (
                        select doc_id, kind, s, k, ch, count(*) as c from (
                            select doc_id, kind, s, k, unnest(string_split(substr(m, k, {c.window}), '')) as ch from ({found}) f, unnest(range(1, n - {c.window} + 2)) t(k)) group by all)
                    group by all having h >= {c.bits} - 1e-9))) group by doc_id, kind, s, run""")
    order = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(["assign", "access", "hex", *(c.kind for c in CLASSES)])) + " end"
    join = f"coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, {order}, s + n){{}}, '')"
    return f"""
        with d as (select doc_id, translate(coalesce(text, ''), chr(1), chr(2)) as text from documents),
        b as ({" union all ".join(base)}), a as (select * from b union all {" union all ".join(more)})
        select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
            sha256({join.format(" filter (kind in ('assign', 'access', 'hex'))")}) as base_sha256, {join.format("")} as spans
        from d left join a using (doc_id) group by d.doc_id
    """


def passages(n: int = 13) -> str:
    return f"""
        with w as (select doc_id, {_WORDS} as ws from documents),
        win as (select doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') as g from w, unnest(range(1, len(ws) - {n - 2})) t(i)),
        first as (select g, min(doc_id) as m from win group by 1),
        gone as (select distinct doc_id, unnest(range(i, i + {n})) as p from win join first using (g) where m < doc_id),
        one as (select doc_id, p, ws[p] as word from w, unnest(range(1, len(ws) + 1)) t(p)),
        kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from one anti join gone using (doc_id, p) group by 1)
        select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
        from w left join kept using (doc_id)
    """


def lines(threshold: str = "0.8") -> str:
    return rf"""
        with d as (select doc_id, coalesce(text, '') as text from documents),
        l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line from d),
        s as (select doc_id, n, line, list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+')) as ws from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
        x as (select line, any_value(ws) as ws, len(any_value(ws)) as size, min((doc_id, n)) as place, row_number() over () as id from s group by line),
        t as (select id, size, unnest(ws) as w from x),
        p as (select a.id as a, b.id as b, a.size + b.size as both, count(*) as c from t a join t b using (w)
            where a.id < b.id and least(a.size, b.size) >= {threshold} * greatest(a.size, b.size) - 1e-9 group by all having count(*) >= (a.size + b.size - count(*)) * {threshold} - 1e-9),
        e as (select a, b from p union all select b, a from p),
        k as (select x.id, count(e.b) as links, coalesce(bool_or(y.place < x.place), false) as later from x left join e on e.a = x.id left join x y on y.id = e.b group by 1),
        r as (select s.doc_id, s.n, (k.later or (s.doc_id, s.n) > x.place) as gone, k.links from s join x using (line) join k on k.id = x.id),
        g as (select doc_id, count(*) filter (gone) as n_removed, sum(links) as n_links, coalesce(string_agg(n, ',' order by n) filter (gone), '') as removed_lines from r group by 1)
        select doc_id, cast(len(string_split(text, chr(10))) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_links, 0) as bigint) as n_links, coalesce(removed_lines, '') as removed_lines
        from d left join g using (doc_id)
    """


def vectors(similarity: float = 0.93) -> str:
    return f"""
        with recursive u as (select vec_id as n, label, cast(embedding as double[]) as v from embeddings
            where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        v as (select vec_id as n from embeddings),
        e as (select a.n as a, b.n as b from u a join u b on a.label = b.label and a.n < b.n where list_cosine_similarity(a.v, b.v) >= {similarity}),
        {_REACH.strip()},
        deg as (select a as n, count(*) as k from ends group by 1)
        select v.n as vec_id, cast(coalesce(k, 0) as bigint) as n_links, c as component_id, v.n = c as kept from v join comp using (n) left join deg using (n)
    """


def near_documents(k: int = 4) -> str:
    low = _LOWER.format("coalesce(text, '')")
    return rf"""
        with recursive w as (select doc_id as n, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') as ws from documents),
        s as (select distinct n, g from (select n, array_to_string(ws[i:i + {k - 1}], ' ') as g from w, unnest(range(1, greatest(len(ws) - {k - 2}, 2))) t(i) where len(ws) > 0)),
        z as (select n, count(*) as c from s group by 1),
        v as (select doc_id as n from documents),
        p as (select a.n as a, b.n as b, count(*) as c from s a join s b using (g) where a.n < b.n group by 1, 2),
        e as (select a, b from p join z x on x.n = a join z y on y.n = b where 100 * p.c >= 80 * (x.c + y.c - p.c)),
        {_REACH.strip()}
        select v.n as doc_id, cast(coalesce(z.c, 0) as bigint) as n_shingles, comp.c as component_id, v.n = comp.c as kept from v join comp using (n) left join z using (n)
    """


def archives() -> str:
    return """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
        f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
        select d.page_id, d.payload_bytes, d.payload_digest,
            case when payload_bytes >= 100 and d.page_id > f.first_id then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and d.page_id > f.first_id then f.first_id end as refers_to
        from d left join f using (payload_digest)
    """


ORACLE_SQL = {
    "op1_secret_scan": secrets(),
    "op2_substring_dedup": passages(),
    "op4_line_dedup": lines(),
    "op5_embedding_dedup": vectors(),
    "op6_minhash_dedup": near_documents(),
    "op7_license_scan": licenses(),
    "op8_warc": archives(),
}
