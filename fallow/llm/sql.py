"""SQL statements of the queries that SQL can state; written out apart from the operators."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """One row per span of a kind: leftmost matches, then those with too short a group dropped."""
    return f"""
    select rid, doc_id, '{kind}' as kind, {rank} as rank, first as s, first + size as e
    from (
        select rid, doc_id, g,
            list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as first,
            length(hits[i]) as size
        from (
            select rid, doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) as i, unnest(parts) as g
            from (
                select rid, doc_id, regexp_extract_all(text, $re${pattern}$re$, 0) as hits,
                    regexp_extract_all(text, $re${pattern}$re$, {group}) as parts,
                    regexp_split_to_array(text, $re${pattern}$re$) as gaps
                from docs where regexp_matches(text, $re${pattern}$re$)
            )
        )
    ) where length(g) >= {least}"""


_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
_KEYS = _ANY_CASE + "|[aA][pP][iI]_?[kK][eE][yY]"

OP1 = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
spans as ({" union all ".join((
    _spans("assign", 0, "(" + _KEYS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    _spans("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    _spans("hex", 2, "[0-9a-f]+", 0, 16),
    _spans("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    _spans("chat", 4, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
))}),
joined as (
    select rid,
        count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
        coalesce(string_agg(concat_ws(':', kind, s, e), ',' order by s, rank) filter (rank < 3), '') as base,
        string_agg(concat_ws(':', kind, s, e), ',' order by s, rank) as spans
    from spans group by rid
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join joined using (rid)
"""

OP2 = f"""
with recursive words as (
    select doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') as w from documents
),
sets as (
    select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as shingle
    from words
),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as (
    select a, b from (
        select x.doc_id as a, y.doc_id as b, count(*) as shared
        from sets x join sets y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all
    ) join sizes p on p.doc_id = a join sizes q on q.doc_id = b
    where 100 * shared >= 85 * (p.n + q.n - shared)
),
reach as (
    select doc_id as a, doc_id as b from documents
    union
    select reach.a, links.b from reach join links on links.a = reach.b
),
groups as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join groups on groups.doc_id = d.doc_id
"""

OP5 = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
whole as (
    select conv_id, count(*) as n_turns,
        string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
        coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as learned,
        sum(length('<turn><says></turn>') + length(regexp_replace(role, '(\\|<turn>|<says>|</turn>)', '\\\1', 'g'))
            + length(regexp_replace(text, '(\\|<turn>|<says>|</turn>)', '\\\1', 'g'))) as shown
    from turns group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256,
    shown::bigint as formatted_chars
from whole
"""

_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
_SIBLINGS = (
    f"attribution{_GAP}+(?:non{_GAP}+commercial|noncommercial|share{_GAP}+alike|sharealike|no{_GAP}+deriv|noderiv)",
    f"{_GAP}nc{_GAP}+(?:sa|nd){_GAP}",
    f"gnu{_GAP}+(?:lesser|affero|library){_GAP}+general",
)
_PLAIN = "' ' || lower(coalesce(text, '')) || ' '"
for _pattern in (_SIBLINGS[0], _SIBLINGS[1], _SIBLINGS[1], _SIBLINGS[2]):  # two neighbours share a gap, hence twice
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', ' ', 'g')"

# Every window of twice a notice's length that begins with any word is held against the notice.
OP6 = f"""
with templates(label, size, need, own, names) as (values
    ('mit-notice', 5, 4, ['license', 'mit', 'released', 'the', 'under'], ['license', 'mit', 'released']),
    ('mit-grant', 20, 16, ['a', 'and', 'any', 'associated', 'charge', 'copy', 'documentation', 'files', 'free', 'granted', 'hereby',
        'is', 'obtaining', 'of', 'permission', 'person', 'software', 'this', 'to'], []),
    ('apache-2.0', 8, 7, ['0', '2', 'apache', 'license', 'licensed', 'the', 'under', 'version'], ['0', '2', 'apache']),
    ('gpl-3.0', 12, 10, ['3', 'general', 'gnu', 'is', 'license', 'licensed', 'public', 'the', 'this', 'under', 'version', 'work'],
        ['3', 'general', 'gnu', 'public']),
    ('cc-by-nc-4.0', 7, 6, ['0', '4', 'by', 'cc', 'licensed', 'nc', 'under'], ['0', '4', 'by', 'cc', 'nc']),
    ('cc-by-4.0', 13, 11, ['0', '4', 'a', 'attribution', 'commons', 'creative', 'international', 'is', 'license', 'licensed', 'this',
        'under', 'work'], ['0', '4', 'attribution', 'commons', 'creative', 'international']),
    ('bsd', 21, 16, ['and', 'are', 'binary', 'conditions', 'following', 'forms', 'in', 'met', 'modification', 'or', 'permitted',
        'provided', 'redistribution', 'source', 'that', 'the', 'use', 'with', 'without'], [])
),
docs as (
    select row_number() over () as rid, doc_id, coalesce(text, '') as text,
        regexp_extract_all({LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w
    from documents
),
places as (
    select rid, doc_id, text, len(w) as n_words,
        list_filter(range(0, len(w)), lambda i: w[i + 1] = 'mit' and w[i + 2] = 'license') as mit,
        list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' and w[i + 2] = 'license') as apache,
        list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license') as gpl
    from docs
),
plain as (select row_number() over () as rid, regexp_extract_all({_PLAIN}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
near as (select rid, w, t.* from plain, templates t where len(list_intersect(w, own)) >= need),
windows as (
    select rid, label, own, need, names, w[i:i + 2 * size - 1] as b from (select *, unnest(range(1, len(w) + 1)) as i from near)
    where list_contains(own, w[i])
),
met as (
    select rid, label, len(list_intersect(b, own)) / len(own) as score
    from windows where len(list_intersect(b, own)) >= need and list_has_all(b, names)
),
best as (select rid, list(distinct label) as found, max(score) as score from met group by rid),
named as (
    select *, list_concat(case when len(mit) > 0 then ['mit'] else [] end, case when len(apache) > 0 then ['apache'] else [] end,
        case when len(gpl) > 0 then ['gpl'] else [] end) as base
    from places left join best using (rid)
)
select doc_id, n_words, len(mit) + len(apache) + len(gpl) as n_base,
    list_min(mit || apache || gpl) as first_word, list_max(mit || apache || gpl) as last_word,
    array_to_string(list_sort(base), ',') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') as labels,
    greatest(coalesce(score, 0.0), case when len(base) > 0 then 1.0 else 0.0 end)::double as score
from named
"""

OP7 = """
with rules(verdict, host, path) as (values
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
),
rest as (
    select row_number() over () as rid, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
    from pages
),
parts as (
    select rid, page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from rest
),
ranked as (
    select p.*, r.host || r.path as rule, r.verdict,
        row_number() over (partition by rid order by length(r.host || r.path) desc nulls last, length(r.host) desc, r.verdict desc) as place
    from parts p left join rules r
        on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from ranked where place = 1
"""

OP11 = """
with whole as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
words as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by t) as least from whole),
failing as (
    select doc_id, part,
        case when len(w) < 100 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
            || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end
            || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when doc_id > least then 'E' else '' end as fails
    from words
),
judged as (
    select part, fails, doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic
    from failing
),
cells as (select part, fails, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from judged group by all),
letters(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order
    from letters a, letters b, letters c, letters d, letters e
    where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)
),
steps as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from orders),
met as (
    select *, substr(filter_order, step, 1) as letter,
        strpos(fails, substr(filter_order, step, 1)) > 0 as hit,
        fails <> '' and translate(left(filter_order, step - 1), fails, '') <> left(filter_order, step - 1) as gone
    from steps, cells
),
counted as (
    select part, filter_order, step, letter,
        sum(n) filter (not hit and not gone) as kept, sum(n) filter (hit and not gone) as removed, sum(n) filter (hit and gone) as redundant,
        sum(n) filter (fails = letter) as unique_fails, sum(n_good) filter (hit and not gone) as good_lost, sum(n_toxic) filter (hit and not gone) as toxic_lost
    from met group by all
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
    coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
    sum(coalesce(removed, 0)) over (partition by part, letter)::bigint as shapley
from counted
"""

OP12 = f"""
with terms as (
    select row_number() over () as rid, doc_id, regexp_extract_all({LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as t from documents
),
docs as (select *, len(t) as n from terms where len(t) > 0),
total as (select count(*) as docs, sum(n)::bigint as size from docs),
asked as (
    select row_number() over () as iid, item_id,
        unnest(list_distinct(regexp_extract_all({LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'))) as term
    from benchmark
),
said as (select rid, unnest(t) as term from docs),
counts as (select rid, term, count(*) as tf from said where term in (select term from asked) group by all),
weights as (
    select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from counts, total group by term
),
scored as (
    select iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // size))))::bigint as score
    from asked join weights using (term) join counts using (term) join docs using (rid), total
    group by all
),
ranked as (
    select item_id, row_number() over (partition by iid order by score desc, doc_id nulls last) as rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""

SQL = {
    "op1_secret_scan": OP1,
    "op2_minmax_dedup": OP2,
    "op5_chat_format": OP5,
    "op6_license_scan": OP6,
    "op7_url_rules": OP7,
    "op11_filter_audit": OP11,
    "op12_lexical_search": OP12,
}
