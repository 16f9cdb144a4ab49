"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

#: Words of op2, of a lower-cased text.
_WORDS2 = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: crc32 of a decimal number, byte by byte.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ord(c) as bigint))),
        lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))))"""

#: Marks that lines may end in and letters without spaces, as op10 has them.
_ENDS = r"""regexp_matches(last, '[.!?:;"'')\]}]') or (regexp_matches(last, '[\p{Pe}\p{Pf}\p{Pi}\p{Po}]')
        and not regexp_matches(last, '[\x00-\x7F،、，﹐﹑､·•‣․‥‧‰‱†‡※§¶⁂⁎⁑＃％＆＊＠／＼]'))"""
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"

ORACLES = {
    "op10_quality_rules": rf"""
with split as (
    select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
windows as (
    select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i : i + 2], ' ')) as times
    from split, unnest(range(1, len(w) - 1)) as u(i)
),
repeated as (select doc_id, count(distinct i + k) as n from windows, unnest([0, 1, 2]) as u(k) where times > 1 group by doc_id),
lines as (
    select doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w, right(rtrim(line, ' '), 1) as last, lower(line) as low
    from split, unnest(string_split(body, chr(10))) as u(line)
),
measured as (
    select doc_id, line, len(w) as n, len(w) + len(array_to_string(regexp_extract_all(line, '{_UNSPACED}'), '')) / 4 >= 12 as filled,
        {_ENDS} as ended, strlen(line) > length(line) as beyond_ascii,
        len(list_filter(w, lambda x: x in ('|', '>', '»', '•', '·', '/'))) as lone,
        len(list_filter(w, lambda x: regexp_matches(x, '[!?][!?]$'))) as shouted,
        len(regexp_extract_all(line, '[#*$%&<>]')) as symbols,
        regexp_matches(low, 'all rights reserved|terms of service|terms of use|privacy policy|cookie policy|use cookies|uses cookies'
            '|accept cookies|enable javascript|javascript is disabled|lorem ipsum|sign up for|subscribe to our|newsletter|click here'
            '|read more|share this|follow us|log in|powered by') as page
    from lines where len(w) > 0
),
ruled as (
    select *, (n < 12 and not ended and not (beyond_ascii and filled)) or (lone > 0 and lone > 0.2 * n) or (shouted > 0 and shouted > 0.5 * n)
        or (symbols > 0 and symbols > 0.3 * n) or (n <= 40 and page) as fails
    from measured
),
by_document as (
    select doc_id, count(*) - count(distinct line) as n_dup_lines, coalesce(sum(n) filter (fails), 0) as lost from ruled group by doc_id
),
base as (
    select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        len(regexp_extract_all(body, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
        coalesce(repeated.n, 0) as n_repeat_words, len(w) < 50 or 100 * coalesce(repeated.n, 0) > 50 * len(w) as base_failed,
        cast(coalesce(lost, 0) as bigint) as n_lost_words
    from split left join repeated using (doc_id) left join by_document using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and n_lost_words <= 0.5 * n_words as kept, n_lost_words
from base
""",
    "op6_warc": rf"""
with sized as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as sha from pages
),
winners as (select sha, max(page_id) as winner from sized group by sha),
digests as (
    select sha, array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', 1 + cast(list_sum(
        list_transform(range(0, 5), lambda k: ((strpos('0123456789abcdef', substr(sha, (5 * i + k) // 4 + 1, 1)) - 1)
            // (1 << (3 - (5 * i + k) % 4)) % 2) * (1 << (4 - k)))) as int), 1)), '') as payload_digest
    from winners
)
select page_id, payload_bytes, payload_digest,
    case when page_id = winner then 'response' else 'revisit' end as record_type,
    case when page_id = winner then null else winner end as refers_to
from sized join winners using (sha) join digests using (sha)
""",
    "op2_decontamination": rf"""
with item_words as (
    select coalesce(cast(item_id as varchar), '') as item_id, {_WORDS2} as w from benchmark where text is not null
),
windows as (
    select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
    from item_words, unnest(range(1, greatest(len(w) - 8, 2))) as u(i)
    where len(w) > 0
),
doc_words as (select doc_id, {_WORDS2} as w from documents),
sizes as (select distinct n from windows),
places as (
    select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as win
    from doc_words, sizes, unnest(range(1, len(w) - n + 2)) as u(i)
),
hits as (select doc_id, i, places.n, item_id from places join windows using (n, win)),
hit_words as (
    select doc_id, count(distinct p) as n_hit from hits, unnest(range(i, i + n)) as u(p) group by doc_id
),
hit_items as (select distinct doc_id, item_id from hits),
named as (
    select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from hit_items group by doc_id
)
select doc_id,
    coalesce(len(w), 0) as n_words,
    coalesce(n_hit, 0) as n_hit,
    coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit_words using (doc_id) left join named using (doc_id)
""",
    "op13_prefix_trie": rf"""
with own as (
    select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as d,
        md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as said,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
    from conversations where conv_id is not null
),
ids as (select conv_id, {_CRC} % 4 as h from (select distinct conv_id from own)),
rebuilt as (
    select ids.conv_id, 0 as part, d, said, words from ids join own on own.conv_id = ids.conv_id - ids.conv_id % 20 and d <= h
    union all
    select conv_id, 1, d, said, words from own join ids using (conv_id) where d > h
),
sequences as (
    select ids.conv_id, coalesce(list(said order by part, d) filter (said is not null), []) as said,
        coalesce(list(words order by part, d) filter (said is not null), []) as words
    from ids left join rebuilt using (conv_id) group by ids.conv_id
),
prefixes as (
    select conv_id, d, len(said) = d as ends, md5(array_to_string(said[:d], ' ')) as node, md5(array_to_string(said[:d - 1], ' ')) as above, words[d] as w
    from sequences, unnest(range(0, len(said) + 1)) as u(d)
),
nodes as (
    select d, node, min(above) as above, min(conv_id) as conv_id, count(*) as n, (count(*) - 1) * coalesce(min(w), 0) as saved,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
    from prefixes group by d, node
),
families as (select d - 1 as d, above as node, count(*) as children from nodes where d > 0 group by all),
whole as (select nodes.*, coalesce(children, 0) as children from nodes left join families using (d, node)),
ancestors as (
    select p.d, p.node, sum(whole.saved) as saved, count(*) filter (whole.children = 0) as leaves
    from whole join prefixes p on p.conv_id = whole.conv_id and p.d <= whole.d group by p.d, p.node
)
select n.conv_id, n.d as depth, up.conv_id as parent_conv_id, n.n as n_convs, n.children as n_children,
    cast(a.leaves as bigint) as n_leaves, cast(a.saved as bigint) as saved_tokens, n.ends_sha256
from whole n join ancestors a using (d, node) left join nodes up on up.d = n.d - 1 and up.node = n.above
""",
    "op9_near_duplicates": r"""
with recursive split as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
),
shingles as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from split, unnest(range(1, greatest(len(w) - 3, 2))) as u(i) where len(w) > 0
),
sizes as (select doc_id, count(*) as n from shingles group by 1),
shared as (
    select a.doc_id as u, b.doc_id as v, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
),
links as (
    select u, v from shared join sizes a on a.doc_id = u join sizes b on b.doc_id = v where 100 * k >= 85 * (a.n + b.n - k)
),
edges as (select u, v from links union all select v, u from links),
reached as (
    select doc_id as u, doc_id as v from documents
    union
    select reached.u, edges.v from reached join edges on edges.u = reached.v
),
named as (select u as doc_id, min(v) as component_id from reached group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from named left join sizes using (doc_id)
""",
}
