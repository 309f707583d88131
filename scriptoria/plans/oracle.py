"""SQL counterparts of the core queries, for DuckDB over the same tables.

Folds are recursive queries, spans are rebuilt from the pieces between matches.
"""

from __future__ import annotations

import re

from ..functions import tags, text, units
from ..functions.regex import ND, NOT_WORD, WORD, WS
from ..operators import profile, retrieval

SQL: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(rule: str) -> str:
    return re.sub(r"\$(\d)", r"\\\1", rule)


def _chain(t: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        t = f"regexp_replace({t}, {_q(pattern)}, {_q(_re2(by))}, 'g')"
    return t


def _strip(t: str) -> str:
    return f"regexp_replace({t}, {_q(rf'^{WS}+|{WS}+\z')}, '', 'g')"


TEXTS = "(select distinct origin, row_id, text from (select 'text_blocks' as origin, block_id as row_id, text from text_blocks union all select 'chunks', chunk_id, text from chunks) where text is not null)"
ONCE = "(select * exclude (rn) from (select *, row_number() over (partition by block_id order by extracted_at desc, text desc nulls last) as rn from text_blocks) where rn = 1)"
BLOCKS = f"(select *, coalesce(bbox.x0, 0.0) as x0, coalesce(bbox.y0, 0.0) as y0, coalesce(bbox.x1, 0.0) as x1, coalesce(bbox.y1, 0.0) as y1 from {ONCE} where text is not null and {_strip('text')} <> '')"
PLACED = f"(select *, cast(row_number() over (partition by doc_id, page_num order by y0, x0, block_num) - 1 as integer) as position from {BLOCKS})"
PAGES = f"(select doc_id, page_num, string_agg(text, ' ' order by position) as full_text, count(*) as n from {PLACED} group by all)"
RECORDS = "(select distinct * from page_records)"

# --- detection and layout
SQL["detect_page_text"] = f"select doc_id, page_num, length({_strip('full_text')}) > 50 as has_text from {PAGES}"
SQL["detect_doc_type"] = f"""
    with p as (select doc_id, count(*) filter (page_num < 5) as sample_size, count(*) filter (page_num < 5 and coalesce(has_text, false)) as vector_pages, count(*) as total_pages from {RECORDS} group by doc_id),
    r as (select *, case when sample_size > 0 then cast(vector_pages as double) / sample_size end as r from p)
    select doc_id, case when r is null then 'unknown' when r >= 0.9 then 'vector' when r <= 0.1 then 'scan' else 'mixed' end as type,
      round(case when r is null then 0.0 when r >= 0.9 then r when r <= 0.1 then 1 - r else 0.5 + abs(0.5 - r) end, 6) as confidence,
      vector_pages, sample_size - vector_pages as scan_pages, sample_size, total_pages from r"""
SQL["path_check"] = "select doc_id, revision, case when file_path is null then 'file not found' when lower(file_path) not like '%.pdf' then 'not a PDF file' end as error from source_files"
SQL["reading_order"] = f"select doc_id, page_num, position, block_num, text from {PLACED}"
SQL["merge_blocks"] = f"""
    with recursive o as (select doc_id, page_num, position as i, x0, y0, x1, y1, text, block_num from {PLACED}),
    m as (
      select doc_id, page_num, i, 0 as g, x0, y0, x1, y1, text, block_num from o where i = 0
      union all
      select o.doc_id, o.page_num, o.i, case when near then m.g else m.g + 1 end,
        case when near then least(m.x0, o.x0) else o.x0 end, case when near then least(m.y0, o.y0) else o.y0 end,
        case when near then greatest(m.x1, o.x1) else o.x1 end, case when near then greatest(m.y1, o.y1) else o.y1 end,
        case when near then m.text || ' ' || o.text else o.text end, case when near then m.block_num else o.block_num end
      from m join (select * from o) o on o.doc_id = m.doc_id and o.page_num = m.page_num and o.i = m.i + 1,
      lateral (select abs(m.y0 - o.y0) < 10 and o.x0 - m.x1 < 20 as near) n)
    select doc_id, page_num, cast(g as integer) as position, block_num, x0, y0, x1, y1, text
    from (select *, row_number() over (partition by doc_id, page_num, g order by i desc) as rn from m) where rn = 1"""
CUT = f"(select doc_id, page_num, position as i, y0, block_num, case when block_num % 2 = 1 then text || '-' else text end as text from {PLACED})"
SQL["dehyphenate"] = f"""
    with recursive o as (select *, lead(text) over w as nt, lead(y0) over w as ny, lead(block_num) over w as nb from {CUT} window w as (partition by doc_id, page_num order by i)),
    j as (select *, coalesce(text like '%-' and nt is not null and abs(y0 - ny) > 10, false) as joins, instr(nt, ' ') as c from o),
    s as (
      select doc_id, page_num, i, joins as took, true as shown from j where i = 0
      union all
      select j.doc_id, j.page_num, j.i, case when s.took then false else j.joins end, not s.took from s join j on j.doc_id = s.doc_id and j.page_num = s.page_num and j.i = s.i + 1),
    e as (
      select j.doc_id, j.page_num, j.i, 0 as sub, j.block_num, case when joins then left(text, length(text) - 1) || (case when c > 0 then left(nt, c - 1) else nt end) else text end as text
      from s join j using (doc_id, page_num, i) where shown
      union all
      select j.doc_id, j.page_num, j.i, 1, nb, substr(nt, c + 1) from s join j using (doc_id, page_num, i) where shown and took and c > 0 and substr(nt, c + 1) <> '')
    select doc_id, page_num, cast(row_number() over (partition by doc_id, page_num order by i, sub) - 1 as integer) as position, block_num, text from e"""
SQL["page_assemble_merged"] = f"""
    with recursive o as (
      select *, lead(text) over w as nt, lead(y0) over w as ny, lead(x0) over w as nx, lead(y1) over w as ny1, lead(x1) over w as nx1, lead(block_num) over w as nb
      from (select doc_id, page_num, position as i, x0, y0, x1, y1, block_num, case when block_num % 2 = 1 then text || '-' else text end as text from {PLACED}) window w as (partition by doc_id, page_num order by i)),
    j as (select *, coalesce(text like '%-' and nt is not null and abs(y0 - ny) > 10, false) as joins, instr(nt, ' ') as c from o),
    s as (
      select doc_id, page_num, i, joins as took, true as shown from j where i = 0
      union all
      select j.doc_id, j.page_num, j.i, case when s.took then false else j.joins end, not s.took from s join j on j.doc_id = s.doc_id and j.page_num = s.page_num and j.i = s.i + 1),
    e as (
      select j.doc_id, j.page_num, j.i, 0 as sub, x0, y0, x1, y1, block_num, case when joins then left(text, length(text) - 1) || (case when c > 0 then left(nt, c - 1) else nt end) else text end as text
      from s join j using (doc_id, page_num, i) where shown
      union all
      select j.doc_id, j.page_num, j.i, 1, nx, ny, nx1, ny1, nb, substr(nt, c + 1) from s join j using (doc_id, page_num, i) where shown and took and c > 0 and substr(nt, c + 1) <> ''),
    d as (select * replace (row_number() over (partition by doc_id, page_num order by i, sub) - 1 as i) from e),
    m as (
      select doc_id, page_num, i, 0 as g, x0, y0, x1, y1, text, block_num from d where i = 0
      union all
      select d.doc_id, d.page_num, d.i, case when near then m.g else m.g + 1 end,
        case when near then least(m.x0, d.x0) else d.x0 end, case when near then least(m.y0, d.y0) else d.y0 end,
        case when near then greatest(m.x1, d.x1) else d.x1 end, case when near then greatest(m.y1, d.y1) else d.y1 end,
        case when near then m.text || ' ' || d.text else d.text end, case when near then m.block_num else d.block_num end
      from m join d on d.doc_id = m.doc_id and d.page_num = m.page_num and d.i = m.i + 1, lateral (select abs(m.y0 - d.y0) < 10 and d.x0 - m.x1 < 20 as near) n),
    f as (select * from (select *, row_number() over (partition by doc_id, page_num, g order by i desc) as rn from m) where rn = 1)
    select doc_id, page_num, cast(count(*) as integer) as block_count, cast(length(string_agg(text, ' ')) as integer) as char_count, string_agg(text, ' ' order by y0, x0, block_num, x1, y1, text) as full_text from f group by doc_id, page_num"""
SQL["page_assemble"] = f"""
    select r.doc_id, r.page_num, cast(coalesce(p.n, 0) as integer) as block_count, cast(coalesce(length(p.full_text), 0) as integer) as char_count, coalesce(p.full_text, '') as full_text
    from (select distinct doc_id, page_num from page_records) r left join {PAGES} p on p.doc_id = r.doc_id and p.page_num = r.page_num"""
SQL["doc_statistics"] = f"""
    select doc_id, count(*) as total_pages, cast(sum(block_count) as bigint) as total_blocks, cast(sum(char_count) as bigint) as total_characters,
      round(cast(sum(block_count) as double) / count(*), 6) as avg_blocks_per_page from {RECORDS} group by doc_id"""
SQL["heading_classify"] = f"""
    with a as (select doc_id, round(avg(font_size), 9) as a from {BLOCKS} where font_size <> 0 group by doc_id)
    select block_id, case when a is null then null when coalesce(font_size, 0) = 0 then 'unknown' when font_size > 1.3 * a then 'heading1'
      when font_size > 1.15 * a then 'heading2' when font_size > 1.05 * a then 'heading3' else 'paragraph' end as structure_type
    from {BLOCKS} left join a using (doc_id)"""

# --- text
_control = lambda t: f"regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\p{{Cf}}\\p{{Co}}]', ' ', 'g')"


def _unicode(t: str) -> str:
    t = f"nfc_normalize({t})"
    for bad, good in text.MOJIBAKE:
        t = f"replace({t}, {_q(bad)}, {_q(good)})"
    return f"regexp_replace({t}, '[​‌‍﻿]', '', 'g')"


def _spaces(t: str) -> str:
    return f"array_to_string(list_transform(string_split({_chain(t, text.SPACE_RULES)}, chr(10)), lambda x: {_strip('x')}), chr(10))"


_punctuation = lambda t: _chain(t, text.PUNCTUATION_RULES)
_normal = lambda t: f"case when {t} = '' then {t} else {_strip(_punctuation(_spaces(_unicode(_control(t)))))} end"


def _stage(expression: str) -> str:
    return f"select origin, row_id, {expression} as result from {TEXTS}"


SQL["text_control_chars"] = _stage(_control("text"))
SQL["text_unicode_fix"] = _stage(_unicode("text"))
SQL["text_whitespace"] = _stage(_spaces("text"))
SQL["text_punctuation"] = _stage(_punctuation("text"))
SQL["text_normalize"] = _stage(_normal("text"))

_opens = (  # a number, a bullet, a label with a colon, or up to five words in capitals
    rf"regexp_matches(line, {_q(rf'^{ND}+[.)]{WS}+|^[-•*]{WS}+|^[A-Z][^.!?]*:{WS}*$')})"
    rf" or upper(replace(line, 'ß', 'SS')) = line and lower(line) <> line and len(list_filter(regexp_split_to_array(line, {_q(WS + '+')}), lambda x: x <> '')) <= 5"
)
SQL["text_paragraphs"] = f"""
    with a as (select origin, row_id, string_split({_normal('text')}, chr(10) || chr(10)) as blocks from {TEXTS}),
    b as (select origin, row_id, n, string_split(blocks[n], chr(10)) as lines from (select *, unnest(range(1, len(blocks) + 1)) as n from a)),
    l as (select origin, row_id, n, i, {_strip('lines[i]')} as line from (select *, unnest(range(1, len(lines) + 1)) as i from b)),
    s as (select *, case when row_number() over w > 1 and ({_opens}) then 1 else 0 end as opens from l where line <> '' window w as (partition by origin, row_id, n order by i)),
    g as (select *, sum(opens) over (partition by origin, row_id, n order by i rows unbounded preceding) as g from s),
    p as (select origin, row_id, n, g, {_strip("string_agg(line, ' ' order by i)")} as paragraph from g group by all)
    select origin, row_id, cast(row_number() over (partition by origin, row_id order by n, g) - 1 as integer) as seq, paragraph from p where paragraph <> ''"""
# --- units
_END = rf"(\z|{NOT_WORD})"


def _superscripts(t: str) -> str:
    rules = [(rf"(?i){a}{WS}*{b}{_END}", rf"{to}$1") for a, b, to in units.SUPERSCRIPTS] + [(rf"{a}{WS}*{b}{_END}", rf"{to}$1") for a, b, to in units.RATES]
    return _chain(t, rules)


def _unit_map(t: str) -> str:
    rules = []
    for key, to in units.unit_keys():
        before = rf"(\A|{NOT_WORD})" if re.match(r"\w", key) else f"({WORD})"
        after = _END if re.search(r"\w$", key) else f"({WORD})"
        rule = (f"(?i){before}{re.escape(key)}{after}", f"$1{to}$2")
        rules += [rule, rule]  # neighbours share the sign between them
    return _chain(t, rules)


_unit_normal = lambda t: f"case when {t} = '' then {t} else {_chain(_chain(_unit_map(_superscripts(t)), units.SPACING_RULES), units.SPECIAL_RULES)} end"
SQL["unit_superscript"] = _stage(_superscripts("text"))
SQL["unit_map"] = _stage(_unit_map("text"))
SQL["unit_spacing"] = _stage(_chain("text", units.SPACING_RULES))
SQL["unit_special"] = _stage(_chain("text", units.SPECIAL_RULES))
SQL["unit_normalize"] = _stage(_unit_normal("text"))
SQL["qa_normalized_blocks"] = f"""
    with a as (select doc_id, text, {_normal('text')} as t from {ONCE}), b as (select doc_id, text, {_unit_normal('t')} as u from a)
    select doc_id, count(*) as blocks, count(*) filter (u is distinct from text) as changed from b group by doc_id"""

# What follows a number to make a quantity. Word boundaries know ASCII only here, so they are looked for in a shadow of the text with one sign for
# each of its signs: superscripts become y and v (whose letters become z, as all others beyond ASCII), digits of other scripts 0.
_ENDS = ["[°℃℉]C?", rf"bar{WS}*\(?[ag]\)?", "[km]?Pa", "psi[ag]?", "m[yv]?/[hs]", "[kt]/h", "[km]?W", "hp", "[mkc]?m[yv]?", "[kt]g?", "%"]
_shadow = lambda t: f"regexp_replace(regexp_replace(replace(replace(regexp_replace({t}, '[yYvV]', 'z', 'g'), '²', 'y'), '³', 'v'), '[^\\x00-\\x7F\\P{{Nd}}]', '0', 'g'), '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]', 'z', 'g')"


def _unit_hits(src: str) -> str:
    """CTEs for the quantities of ``src`` (id, doc_id, text): result ``q``; to follow ``with``."""
    parts = []
    for n, end in enumerate(_ENDS):
        p = _q(rf"(?i)\b[0-9]+\.?[0-9]*{WS}*{end}\b")
        parts.append(f"""
        select id, doc_id, {n} as pattern_no, m[i] as shown, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as integer) as start
        from (select *, unnest(range(1, len(m) + 1)) as i from (select id, doc_id, regexp_extract_all(shadow, {p}) as m, regexp_split_to_array(shadow, {p}) as g from sh) where len(m) > 0)""")
    return f"""
    tx as ({src}), sh as (select *, {_shadow('text')} as shadow from tx), hits as ({' union all '.join(parts)}),
    cutout as (select h.id, h.doc_id, pattern_no, cast(row_number() over (partition by h.id order by pattern_no, start) - 1 as integer) as seq, substr(tx.text, start + 1, length(shown)) as text, start, cast(start + length(shown) as integer) as "end" from hits h join tx on tx.id = h.id),
    q as (select *, {_unit_normal('text')} as normalized from cutout),
    st as (select doc_id, normalized, count(*) as n, min(seq) as first_seq, count(distinct text) as n_variants, list_sort(list(distinct text)) as variants from q group by all),
    rk as (select *, cast(row_number() over (partition by doc_id order by n desc, first_seq, normalized) as integer) as rank from st)"""


_OF_BLOCKS = f"select block_id as id, doc_id, text from {BLOCKS}"
SQL["unit_extract"] = f'with {_unit_hits(_OF_BLOCKS)} select id as block_id, pattern_no, seq, text, start, "end", normalized from q'
SQL["unit_stats"] = f"with {_unit_hits(_OF_BLOCKS)} select doc_id, normalized, n, n_variants, rank from rk"
SQL["qa_unit_profile"] = f"""
    with {_unit_hits(f"select doc_id as id, doc_id, left(string_agg(full_text, ' ' order by page_num), 100000) as text from {PAGES} group by doc_id")}
    select doc_id, cast(sum(n) as bigint) as total_units, count(*) as unique_units, max(normalized) filter (rank = 1) as most_common, max(n) as most_common_count, count(*) filter (n_variants > 1) as n_spelled_differently,
      coalesce(string_agg(normalized || '=' || array_to_string(variants, '/'), ',' order by normalized) filter (n_variants > 1), '') as needs_normalization from rk group by doc_id"""
# --- tags
_tag = lambda t: f"case when {t} = '' then {t} else regexp_replace(regexp_replace(upper(replace({_strip(t)}, 'ß', 'SS')), {_q(rf'(?:{WS}|[-_/\\])+')}, '-', 'g'), '[^\\p{{L}}\\p{{N}}_\\-]', '', 'g') end"
SQL["tag_normalize"] = _stage(_tag("text"))


def _tag_hits(patterns: list[tuple[str, str]], src: str = f"select block_id, text from {BLOCKS}") -> str:
    parts = []
    for n, (name, p) in enumerate(patterns):
        parts.append(f"""
        select block_id, {n} as prio, {_q(name)} as type, m[i] as original,
          cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as integer) as start
        from (select block_id, m, g, unnest(range(1, len(m) + 1)) as i from (select block_id, regexp_extract_all(text, {_q(p)}) as m, regexp_split_to_array(text, {_q(p)}) as g from b) where len(m) > 0)""")
    return f"""b as ({src}), h as ({' union all '.join(parts)}),
      n as (select *, {_tag('original')} as normalized from h),
      f as (select *, row_number() over (partition by block_id, normalized order by prio, start) as rn from n),
      t as (select block_id, cast(row_number() over (partition by block_id order by start, prio) - 1 as integer) as seq, original, normalized, type, start, cast(start + length(original) as integer) as "end" from f where rn = 1)"""


SQL["tag_extract"] = f"with {_tag_hits(tags.PATTERNS)} select * from t"
SQL["tag_extract_isa"] = f"with {_tag_hits(tags.ISA_PATTERNS)} select * from t"
SQL["tag_extract_named"] = f"with {_tag_hits([('pump', dict(tags.PATTERNS)['pump'])])} select * from t"
SQL["tag_custom"] = f"with {_tag_hits([('reference', rf'ref\. {ND}{{7}}/{ND}+')])} select * from t"
SQL["tag_replace"] = f"""
    with recursive {_tag_hits(tags.PATTERNS, f"select origin || chr(1) || row_id || chr(1) || md5(text) as block_id, origin, row_id, text from {TEXTS}")},
    r as (
      select b.block_id, b.text, coalesce(n, 0) as k from b left join (select block_id, count(*) as n from t group by block_id) c using (block_id)
      union all
      select r.block_id, left(r.text, t.start) || t.normalized || substr(r.text, t."end" + 1), r.k - 1 from r join t on t.block_id = r.block_id and t.seq = r.k - 1)
    select origin, row_id, r.text as result from r join b using (block_id) where k = 0"""
_kind = "case " + " ".join(f"when regexp_full_match({_tag('original')}, {_q(p)}) then {_q(n)}" for n, p in tags.PATTERNS) + " end"
SQL["tag_validate"] = f"with {_tag_hits(tags.PATTERNS)}, o as (select distinct original from t) select original, {_kind} is not null as valid, {_tag('original')} as normalized, {_kind} as type from o"
SQL["tag_group"] = f"with {_tag_hits(tags.PATTERNS)} select block_id, type, string_agg(normalized, ',' order by seq) as tags from t group by block_id, type"
SQL["tag_stats"] = f"""
    with {_tag_hits(tags.PATTERNS)}, p as (select block_id, type, count(*) as n, min(seq) as s from t group by all),
    r as (select *, row_number() over (partition by block_id order by n desc, s, type desc) as rn, sum(n) over (partition by block_id) as total from p)
    select block_id, cast(total as bigint) as total_tags, cast((select count(distinct normalized) from t where t.block_id = r.block_id) as bigint) as unique_tags, type as most_common_type, n as most_common_count from r where rn = 1"""
_isa = r"^([A-Z])([A-Z]{0,3})-?(\p{Nd}{3,5})([A-Z])?"


def _meaning(code: str, names: dict[str, str]) -> str:
    return f"case {code} " + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in names.items()) + f" else {code} end"


SQL["tag_parse_isa"] = f"""
    with {_tag_hits(tags.PATTERNS)}, o as (select distinct original, {_tag('original')} as tag from t), v as (select *, regexp_matches(tag, {_q(_isa)}) as valid from o),
    p as (select *, regexp_extract(tag, {_q(_isa)}, 1) as a, regexp_extract(tag, {_q(_isa)}, 2) as b, regexp_extract(tag, {_q(_isa)}, 3) as c, regexp_extract(tag, {_q(_isa)}, 4) as d from v)
    select original, valid, tag, case when valid then {_meaning('a', tags.VARIABLES)} end as variable, case when valid then a end as variable_code,
      case when valid then array_to_string(list_transform(string_split(b, ''), lambda x: {_meaning('x', tags.FUNCTIONS)}), ',') end as functions,
      case when valid then c end as loop_number, case when valid then d end as suffix from p"""

# --- Markdown
_LIST = rf"^{ND}+[.)]{WS}+|^[-•*]{WS}+"


def _item(t: str) -> str:
    numbered, bulleted = _chain(t, [(rf"^({ND}+)[.)]{WS}*", "$1. ")]), _chain(t, [(rf"^[-•*]{WS}*", "- ")])
    return f"case when not regexp_matches({t}, {_q(_LIST)}) then {t} when regexp_matches({t}, {_q('^' + ND)}) then {numbered} else {bulleted} end"


SQL["md_list_format"] = _stage(_item("text"))
RUNS = f"""
    k as (select *, coalesce(structure_type, 'paragraph') as kind from {PLACED}),
    c as (select *, case when lag(kind) over w = kind then 0 else 1 end as c from k window w as (partition by doc_id, page_num order by position)),
    r as (select *, cast(sum(c) over (partition by doc_id, page_num order by position rows unbounded preceding) - 1 as bigint) as run from c)"""
_s = _strip("coalesce(text, '')")
PAGE_MD = f"""{RUNS},
    x as (select *, {_s} as s from r),
    y as (select *, case when s = '' then '' when kind like 'heading%' then (case when kind = 'heading1' or coalesce(font_size, 0) > 16 then '# ' when kind = 'heading2' or coalesce(font_size, 0) > 14 then '## ' else '### ' end) || s else {_item('s')} end as md,
      case when kind like 'heading%' then position else -1 end as part from x),
    z as (select doc_id, page_num, run, part, min(position) as spot, string_agg(md, chr(10) order by position) as md from y group by all),
    pg as (select doc_id, page_num, '<!-- Page ' || (page_num + 1) || ' -->' || chr(10) || chr(10) || string_agg(md, chr(10) || chr(10) order by spot) as markdown from z group by doc_id, page_num)"""
SQL["md_runs"] = f"with {RUNS} select block_id, kind, run from r"
SQL["md_page"] = f"with {PAGE_MD} select doc_id, page_num, markdown from pg"
DOC_MD = f"{PAGE_MD}, dm as (select doc_id, string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_num) as markdown from pg group by doc_id)"
SQL["md_document"] = f"""
    with {DOC_MD} select dm.doc_id, coalesce('---' || chr(10) || 'source: ' || file_path || chr(10) || 'total_pages: ' || coalesce(total_pages, 0) || chr(10) || 'total_blocks: 0' || chr(10) || 'total_characters: 0' || chr(10) || '---' || chr(10) || chr(10), '') || markdown as markdown
    from dm left join (select * from source_files where revision = 1) f on f.doc_id = dm.doc_id"""
SQL["md_with_structure"] = f"""
    with {DOC_MD}, f as (select * from source_files where revision = 1),
    pp as (select doc_id, page_num, sum(length(text)) + count(*) - 1 as c, count(*) as b from {PLACED} group by all),
    pg2 as (select doc_id, string_agg(page_num || ':' || c || ':' || b, ',' order by page_num) as pages, cast(sum(b) as bigint) as total_blocks, cast(sum(c) as bigint) as total_characters, round(avg(b), 6) as avg_blocks_per_page from pp group by doc_id),
    hd as (select doc_id, string_agg(page_num || ':' || structure_type || ':' || coalesce(text, ''), ',' order by page_num, position) as headings from {PLACED} where structure_type like 'heading%' group by doc_id)
    select dm.doc_id, cast(length(coalesce('---' || chr(10) || 'source: ' || file_path || chr(10) || 'total_pages: ' || coalesce(total_pages, 0) || chr(10) || 'total_blocks: 0' || chr(10) || 'total_characters: 0' || chr(10) || '---' || chr(10) || chr(10), '') || markdown) as integer) as n_markdown,
      coalesce(headings, '') as headings, pages, total_blocks, total_characters, avg_blocks_per_page, file_path as source_file
    from dm join pg2 using (doc_id) left join hd using (doc_id) left join f using (doc_id)"""
SQL["md_structure"] = f"select doc_id, page_num as page, position, coalesce(text, '') as text, structure_type as level, coalesce(font_size, 0.0) as font_size from {PLACED} where structure_type like 'heading%'"

# --- chunks
SECTIONS = f"""{DOC_MD},
    l as (select doc_id, i, lines[i] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(markdown, chr(10)) as lines from dm))),
    h as (select *, line like '#%' as head, sum(case when line like '#%' then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as s from l),
    f as (select *, min(case when s = 0 and {_strip('line')} <> '' then i end) over (partition by doc_id) as first from h),
    g as (select *, case when line like '%<!-- Page%' and not head and not (s = 0 and i = first) then try_cast(nullif(regexp_extract(line, 'Page (\\d+)', 1), '') as integer) - 1 end as p from f where s > 0 or (first is not null and i >= first)),
    sc as (select doc_id, s, max(case when head then {_strip("regexp_replace(line, '^#+', '')")} end) as heading, cast(coalesce(max(case when head then length(regexp_extract(line, '^#+')) end), 0) as integer) as level,
      coalesce(string_agg(line, chr(10) order by i) filter (not head), '') as content, coalesce(arg_min(p, i) filter (p <> 0), 0) as page_start, coalesce(arg_max(p, i) filter (p is not null), 0) as page_end from g group by doc_id, s),
    sec as (select doc_id, cast(row_number() over (partition by doc_id order by s) - 1 as integer) as section, heading, level, content, page_start, page_end from sc)"""
SQL["chunk_sections"] = f"with {SECTIONS} select * from sec"


def _pack(src: str, most: int = 1000, size=lambda t: f"length({t})") -> str:
    """CTEs that cut ``text`` of ``src`` (with key ``k``): result ``pk(k, sub, text)``; to follow ``with recursive``."""
    two = "chr(10) || chr(10)"
    return f"""
    pa as (select k, string_split(text, {two}) as p from {src}),
    st as (
      select k, 1 as i, len(p) as n, p[1] as buf, 1 as nb, {size('p[1]')} as cur, p[1] as last, cast(null as varchar) as out from pa
      union all
      select st.k, st.i + 1, st.n, case when cur + {size('p[st.i + 1]')} > {most} then last || {two} || p[st.i + 1] else buf || {two} || p[st.i + 1] end, 1,
        case when cur + {size('p[st.i + 1]')} > {most} then {size('p[st.i + 1]')} + length(last) else cur + {size('p[st.i + 1]')} end, p[st.i + 1],
        case when cur + {size('p[st.i + 1]')} > {most} then buf end
      from st join pa on pa.k = st.k where st.i < st.n),
    em as (select k, i, out as text from st where out is not null union all select k, n + 1, buf from st where i = n),
    pk as (select k, cast(row_number() over (partition by k order by i) - 1 as integer) as sub, text from em)"""


SQL["chunk_pack"] = f"with recursive d as (select doc_id as k, text from documents where text is not null), {_pack('d')} select k as doc_id, sub, text from pk"
CHUNKS = f"""{SECTIONS}, live as (select * from sec where {_strip('content')} <> ''),
    big as (select doc_id || chr(1) || section as k, content as text from live where length(content) > 1000), {_pack('big')},
    al as (select doc_id, section, 0 as sub, heading, level, page_start, page_end, content as text from live where length(content) <= 1000
      union all select doc_id, section, sub, heading, level, page_start, page_end, pk.text from live join pk on pk.k = doc_id || chr(1) || section),
    ch as (select doc_id, heading, level, page_start, page_end, text, cast(row_number() over (partition by doc_id order by section, sub) - 1 as integer) as chunk_index from al)"""
SQL["chunk_markdown"] = f"""
    with recursive {CHUNKS} select doc_id || '_chunk_' || format('{{:04d}}', chunk_index) as chunk_id, text, doc_id, page_start, page_end, cast(length(text) as integer) as char_count,
      0 as token_count, chunk_index, cast(null as varchar) as parent_chunk_id, heading, level from ch"""
SQL["chunk_stats"] = f"""
    with recursive {CHUNKS} select doc_id, count(*) as total_chunks, round(avg(length(text)), 6) as avg_size, cast(min(length(text)) as integer) as min_size, cast(max(length(text)) as integer) as max_size, cast(sum(length(text)) as bigint) as total_size,
      array_to_string(list_sort(list(distinct level)), ',') as levels, min(page_start) as first_page, max(page_end) as last_page from ch group by doc_id"""
SQL["chunk_extraction"] = f"""
    with recursive b as (select doc_id, page_num, position, coalesce(text, '') as text, coalesce(structure_type, 'paragraph') as kind from {PLACED}),
    n as (select *, kind like 'heading%' as head, sum(case when kind like 'heading%' then 1 else 0 end) over (partition by doc_id, page_num order by position rows unbounded preceding) as g from b),
    gr as (select doc_id, page_num, g, max(case when head then text end) as heading, coalesce(max(case when head then case kind when 'heading1' then 1 when 'heading2' then 2 else 3 end end), 0) as level,
      coalesce(string_agg(text, chr(10) order by position) filter (not head), '') as text, count(*) filter (not head) as n from n group by all),
    d as (select doc_id || chr(1) || page_num || chr(1) || g as k, text from gr), {_pack('d')},
    ch as (select gr.*, pk.text as piece, cast(row_number() over (partition by doc_id order by page_num, g, sub) - 1 as integer) as chunk_index from gr join pk on pk.k = doc_id || chr(1) || page_num || chr(1) || g)
    select doc_id || '_chunk_' || format('{{:04d}}', chunk_index) as chunk_id, piece as text, doc_id, page_num as page_start, page_num as page_end, cast(length(piece) as integer) as char_count, 0 as token_count, chunk_index,
      cast(null as varchar) as parent_chunk_id, heading, level, cast(n as varchar) as metadata from ch"""
_words = lambda t: f"len(list_filter(regexp_split_to_array({t}, '[ \\t\\n\\r]+'), lambda x: x <> ''))"
SQL["chunk_pack_tokens"] = f"with recursive d as (select doc_id as k, text from documents where text is not null), {_pack('d', 120, _words)} select k as doc_id, sub, text from pk"


def _path() -> str:
    levels = range(1, 7)
    last = ", ".join(f"max(section) filter (level = {n}) over w as s{n}, arg_max(heading, section) filter (level = {n}) over w as h{n}" for n in levels)
    open_ = lambda n: " and ".join([f"least(level, 7) > {n}", f"s{n} is not null", *(f"coalesce(s{k} < s{n}, true)" for k in range(1, n))])
    parts = ", ".join(f"case when {open_(n)} then h{n} end" for n in levels)
    return f"""p as (select *, {last} from sec window w as (partition by doc_id order by section rows between unbounded preceding and 1 preceding))
    select doc_id, section, case when level > 0 then concat_ws(' > ', {parts}, heading) else '' end as section_path from p"""


SQL["section_path"] = f"with {SECTIONS}, {_path()}"
SQL["chunk_doc_id"] = r"""
    select distinct file_path, left(md5(file_path), 8) as hash_id, left(replace(regexp_replace(regexp_extract(file_path, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1'), ' ', '_'), 20) as stem_id from source_files"""
SQL["expand_window"] = """
    with h as (select distinct doc_id, chunk_index from chunks), c as (select distinct doc_id, chunk_index, chunk_id, text from chunks)
    select h.doc_id, h.chunk_index as hit_index, c.chunk_index, c.chunk_id from h join c on c.doc_id = h.doc_id and c.chunk_index between h.chunk_index - 1 and h.chunk_index + 1"""

SQL["small_to_big"] = """
    with c as (select doc_id, chunk_index, chunk_id, max(text) as text from chunks group by all),
    p as (select *, doc_id || '_parent_' || format('{:04d}', cast(floor((sum(coalesce(length(text), 0)) over (partition by doc_id order by chunk_index rows unbounded preceding) - coalesce(length(text), 0)) / 1600) as integer)) as parent_chunk_id from c)
    select parent_chunk_id, doc_id, cast(count(*) as integer) as n_chunks, coalesce(string_agg(text, chr(10) || chr(10) order by chunk_index), '') as text from p group by all"""

# --- keyword search


def _index(src: str = "documents", key: str = "doc_id", column: str = "text", p: str = "") -> str:
    return f"""
    {p}tk as (select {key} as doc, list_filter(regexp_extract_all(lower(coalesce({column}, '')), {_q(WORD + '+')}), lambda w: length(w) > 2) as w from {src}),
    {p}po as (select doc, term, count(*) as tf from (select doc, unnest(w) as term from {p}tk) group by all),
    {p}co as (select count(*) as n, avg(len(w)) as avg_len from {p}tk),
    {p}df as (select term, count(*) as df from {p}po group by term),
    {p}rw as (select term, df, ln((select n from {p}co) - df + 0.5) - ln(df + 0.5) as raw from {p}df),
    {p}te as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from {p}rw) else raw end as idf from {p}rw)"""


def _scores(asked: str, p: str = "") -> str:
    """CTE ``sc(query, doc, score)`` of all documents that share a term with a query of ``asked``."""
    return f"""
    {p}qt as (select query, term, count(*) as times from (select query, unnest(list_filter(regexp_extract_all(lower(text), {_q(WORD + '+')}), lambda w: length(w) > 2)) as term from {asked}) group by all),
    {p}sc as (select query, doc, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / (select avg_len from {p}co)))), 9) as score
      from {p}qt join {p}te using (term) join {p}po using (term) join {p}tk using (doc) group by query, doc)"""


def _ranked(asked: str, k: int, least: str = "0", p: str = "") -> str:
    return f"""
    {p}al as (select a.query, t.doc, coalesce(s.score, 0.0) as score from {asked} a, {p}tk t left join {p}sc s on s.query = a.query and s.doc = t.doc),
    {p}rk as (select query, doc, score, cast(row_number() over (partition by query order by score desc, doc desc) as integer) as rank from {p}al qualify rank <= {k}),
    {p}re as (select query, doc, score, rank from {p}rk where score >= {least})"""


ASKED = "asked as (select doc_id as query, title as text from documents where doc_id % 50 = 0 and title is not null)"
SQL["bm25_tokenize"] = f"with {_index()} select doc as doc_id, term, tf from po"
SQL["bm25_df_idf"] = f"with {_index()} select term, df, round(idf, 6) as idf from te"
SQL["bm25_stats"] = f"""
    with {_index()} select count(*) as num_documents, round(avg(len(w)), 6) as avg_len, cast(min(len(w)) as integer) as min_len, cast(max(len(w)) as integer) as max_len, cast(sum(len(w)) as bigint) as total_tokens,
      (select count(*) from te) as unique_tokens, case when count(*) = 0 then 'empty' else 'ready' end as status from tk"""
_ONE = "asked as (select 1 as query, 'screw compressor suction pressure' as text)"
SQL["bm25_search"] = f"with {_index()}, {_ONE}, {_scores('asked')}, {_ranked('asked', 10)} select doc, round(score, 6) as score, rank from re"
SQL["bm25_batch_search"] = f"with {_index()}, {ASKED}, {_scores('asked')}, {_ranked('asked', 5)} select query, doc, round(score, 6) as score, rank from re"
SQL["bm25_save_load"] = SQL["bm25_batch_search"]
SQL["bm25_min_score"] = f"with {_index()}, {ASKED}, {_scores('asked')}, {_ranked('asked', 20, '8.0')} select query, doc, round(score, 6) as score, rank from re"
SQL["pipeline_search"] = f"""
    with recursive d as (select doc_id as k, text from documents where text is not null), {_pack('d')},
    c as (select k || '_chunk_' || format('{{:04d}}', sub) as chunk_id, k as doc_id, text from pk), {_index('c', 'chunk_id')}, {_ONE}, {_scores('asked')}, {_ranked('asked', 5)}
    select rank, chunk_id, doc_id, round(score, 6) as score, c.text from re join c on c.chunk_id = re.doc"""

# --- profiles
_empty = f"coalesce({_strip('text')}, '') = ''"
SQL["qa_profile"] = f"""
    select doc_id, count(distinct page_num) as pages, count(*) as blocks, cast(coalesce(sum(length(text)), 0) as bigint) as chars, count(*) filter ({_empty}) as empty_blocks,
      round(cast(count(*) as double) / nullif(count(distinct page_num), 0), 6) as avg_blocks_per_page, round(cast(coalesce(sum(length(text)), 0) as double) / count(*), 6) as avg_chars_per_block,
      round(cast(100 * count(*) filter ({_empty}) as double) / count(*), 6) as empty_percent from {ONCE} group by doc_id"""
SQL["qa_rotated_pages"] = "select distinct doc_id, page_num, rotation from page_records where rotation <> 0"
SQL["qa_charcount_audit"] = f"""
    with r as (select doc_id, page_num, max(char_count) as reported from page_records group by all)
    select r.doc_id, r.page_num, reported, cast(coalesce(length(full_text), 0) as bigint) as actual from r left join {PAGES} p on p.doc_id = r.doc_id and p.page_num = r.page_num
    where reported is distinct from coalesce(length(full_text), 0)"""
SQL["qa_structure_hist"] = f"select coalesce(structure_type, 'unknown') as structure_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from {ONCE} group by 1"
SQL["qa_font_stats"] = f"select doc_id, min(font_size) as min_size, max(font_size) as max_size, round(avg(font_size), 6) as avg_size from {ONCE} where font_size <> 0 group by doc_id"
SQL["qa_font_top5"] = f"select doc_id, font_size, count(*) as n, cast(row_number() over (partition by doc_id order by count(*) desc, font_size) as integer) as rank from {ONCE} where font_size <> 0 group by doc_id, font_size qualify rank <= 5"
SQL["qa_suspicious"] = f"select block_id, doc_id, page_num, left(text, 50) as sample from {ONCE} where regexp_matches(text, '[^\\x00-\\x7F°²³℃℉]')"
SQL["qa_symbol_counts"] = "select doc_id, symbol, cast(sum(n) as bigint) as n from (" + " union all ".join(
    f"select doc_id, {_q(s)} as symbol, (length(text) - length(replace(text, {_q(s)}, ''))) // {len(s)} as n from {ONCE}" for s in profile.SYMBOLS
) + ") where n > 0 group by all"
SQL["qa_rollup"] = f"""
    with p as (select doc_id, page_num, count(*) as b, sum(length(text)) as c, count(*) filter ({_empty}) as e from {ONCE} group by all),
    r as (select doc_id, count(*) as pages, cast(sum(b) as bigint) as blocks, cast(coalesce(sum(c), 0) as bigint) as chars, cast(sum(e) as bigint) as empty_blocks from p group by rollup (doc_id))
    select *, round(100.0 * empty_blocks / blocks, 6) as empty_percent, round(100.0 * empty_blocks / blocks, 6) > 5 as warning from r"""
SQL["qa_first_of_structure"] = f"""
    select coalesce(structure_type, 'unknown') as structure_type, cast(row_number() over (partition by coalesce(structure_type, 'unknown') order by doc_id, page_num, block_num, block_id) as integer) as n, block_id, text
    from {ONCE} qualify n <= 3"""
SQL["qa_page_flag"] = f"select doc_id, page_num, char_count, case when coalesce(char_count, 0) > 100 then 'text' else 'non-text' end as content from {RECORDS}"

# --- sources and service
SQL["ingest_changed_only"] = """
    select doc_id, revision, checksum from source_files s where revision > 1 and not exists (select 1 from source_files m where m.revision = 1 and m.doc_id = s.doc_id and m.checksum = s.checksum)"""
SQL["map_mask"] = "select chunk_id, loaded_at, metadata['profile'] as profile, '***MASKED***' as key from chunks"
SQL["uptime_format"] = """
    select doc_id, revision, case when file_size is not null then concat_ws(' ', case when file_size // 86400 > 0 then (file_size // 86400) || 'd' end, case when file_size // 3600 % 24 > 0 then (file_size // 3600 % 24) || 'h' end,
      case when file_size // 60 % 60 > 0 then (file_size // 60 % 60) || 'm' end, (file_size % 60) || 's') end as uptime from source_files"""

# --- retrieval and evaluation
SQL["vec_topk"] = """
    with s as (select q.vec_id as query, v.vec_id as id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 9) as score from embeddings q, embeddings v where q.vec_id % 50 = 0)
    select query, id, round(score, 6) as score, cast(row_number() over (partition by query order by score desc, id) as integer) as rank from s qualify rank <= 10"""
SQL["rrf_fuse"] = f"""
    with {_index()}, {ASKED}, {_scores('asked')}, {_ranked('asked', 50)}, {_index(column='title', p='t')}, {_scores('asked', 't')}, {_ranked('asked', 50, p='t')},
    u as (select query, doc, rank from re union all select query, doc, rank from tre), s as (select query, doc, round(sum(1.0 / (60 + rank)), 9) as score from u group by all)
    select query, doc, round(score, 6) as score, cast(row_number() over (partition by query order by score desc, doc) as integer) as rank from s qualify rank <= 20"""
SQL["metadata_filter"] = "select doc_id, doc_category, lang from documents where doc_category in ('sop', 'manual') and lang in ('en')"
SQL["locate_tag"] = f"""
    with {_tag_hits(tags.PATTERNS)}, m as (select block_id, max("end" - start) as n from t where normalized = 'KT-228' group by 1)
    select doc_id, page_num, block_id, left(text, 120) as snippet, round(cast(n as double) / length(text), 6) as score from m join {ONCE} o using (block_id)"""
_stop = ", ".join(map(_q, retrieval.STOPWORDS))
SQL["query_intent"] = f"""
    with w as (select item_id, lower(question) as q, list_filter(regexp_split_to_array(lower(question), {_q(WS + '+')}), lambda x: x <> '') as w from eval_items),
    k as (select *, list_filter(w, lambda x: x not in ({_stop})) as k from w)
    select item_id, case when regexp_matches(q, 'where is|locate|which page|find tag|ở đâu|vị trí|trang nào') then 'locate' when regexp_matches(q, 'report|summar|list all|báo cáo|tổng hợp|liệt kê') then 'report'
      when regexp_matches(q, '\\bwhy\\b|explain|how does|tại sao|vì sao|giải thích') then 'explain' else 'qa' end as intent, array_to_string(case when len(k) > 0 then k else w end, ' ') as normalized from k"""
SQL["doc_category_rules"] = """
    select doc_id, case when regexp_matches(lower(title), 'p&id|\\bpid\\b|piping and instrument') then 'pid' when regexp_matches(lower(title), 'data ?sheet|bảng dữ liệu|specification') then 'datasheet'
      when regexp_matches(lower(title), '\\bsop\\b|procedure|quy trình') then 'sop' when regexp_matches(lower(title), 'manual|operation|maintenance|hướng dẫn|bảo dưỡng') then 'om' else 'other' end as category from documents"""
SQL["recall_mrr_ndcg"] = f"""
    with {_index()}, {ASKED}, {_scores('asked')}, {_ranked('asked', 10)}, g as (select distinct query, doc_id as doc from asked join documents on documents.title = asked.text),
    h as (select g.query, re.rank from g left join re on re.query = g.query and re.doc = g.doc),
    p as (select query, count(*) as n_relevant, count(rank) as n_hits, min(rank) as first, sum(case when rank is not null then 1 / log2(rank + 1.0) else 0 end) as dcg from h group by query)
    select query, n_relevant, n_hits, round(n_hits / n_relevant, 6) as recall, round(coalesce(1.0 / first, 0), 6) as mrr, round(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) as ndcg from p"""
SQL["citation_pr"] = """
    with c as (select distinct metadata['profile'] as query, doc_id, page_start as page, 1 as c from chunks), e as (select distinct metadata['profile'] as query, doc_id, page_end as page, 1 as e from chunks),
    p as (select coalesce(c.query, e.query) as query, count(c) as n_cited, count(e) as n_expected, count(*) filter (c is not null and e is not null) as n_right
      from c full join e on c.query = e.query and c.doc_id = e.doc_id and c.page = e.page group by 1)
    select *, round(n_right / nullif(n_cited, 0), 6) as precision, round(n_right / nullif(n_expected, 0), 6) as recall from p"""
SQL["latency_percentiles"] = """
    with e as (select event_type, date_trunc('day', ts) as day, value as latency, event_type = 'error' as failed from events)
    select event_type, cast(day as timestamp) as day, count(*) as calls, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.95), 6) as p95, round(count(*) filter (failed) / count(*), 6) as error_rate from e group by cube (event_type, day)"""
SQL["cache_hit_rate"] = """
    select event_type, count(*) as calls, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(count(*) filter (event_type = 'error') / count(*), 6) as error_rate,
      round(count(*) filter (user_id % 3 = 0) / count(*), 6) as cache_hit_rate from events group by cube (event_type)"""
SQL["stratified_sample"] = """
    select item_id, category, difficulty from (select *, row_number() over (partition by category, difficulty order by md5('42:' || item_id), item_id) as n from eval_items) where n <= 3"""
SQL["qa_specification_rows"] = f"""
    with c as (select distinct chunk_id, 'Parameter Value Unit' || chr(10) || text as text from chunks where text is not null),
    l as (select chunk_id, i, lines[i] as line from (select chunk_id, lines, unnest(range(1, len(lines) + 1)) as i from (select chunk_id, string_split(text, chr(10)) as lines from c))),
    k as (select *, contains(line, 'Parameter') and contains(line, 'Value') as head, contains(line, 'Notes:') as ends from l),
    o as (select *, coalesce(max(i) filter (head) over w, 0) as h, coalesce(max(i) filter (ends and not head) over w, 0) as e from k window w as (partition by chunk_id order by i rows unbounded preceding)),
    t as (select chunk_id, i, {_strip('line')} as line from o where h > e and not head and not ends and {_strip('line')} <> ''),
    w as (select *, cast(row_number() over (partition by chunk_id order by i) - 1 as integer) as seq, regexp_split_to_array(line, {_q(WS + '+')}) as w from t)
    select chunk_id, seq, w[1] as parameter, case when len(w) > 2 then array_to_string(w[2:len(w) - 1], ' ') else w[2] end as value, case when len(w) > 2 then w[len(w)] end as unit from w where len(w) > 1"""
SQL["alert_windows"] = """
    select time_bucket(interval 5 minutes, ts) as window_start, count(*) as calls, round(quantile_cont(value, 0.95), 6) as p95, round(count(*) filter (event_type = 'error') / count(*), 6) as error_rate from events
    group by 1 having quantile_cont(value, 0.95) > 100 or count(*) filter (event_type = 'error') / count(*) > 0.5"""
SQL["config_score"] = """
    with d as (select source, avg(cast(coalesce(lang = 'en', false) as double)) as f, avg(cast(title is not null as double)) as c, avg(cast(coalesce(doc_category = 'sop', false) as double)) as r,
      avg(cast(coalesce(n_chars > 1000, false) as double)) as l, avg(cast(n_chars is null as double)) as k from documents where source is not null group by source)
    select source, round(f * 0.4 + c * 0.25 + r * 0.2 + l * 0.1 + k * 0.05, 6) as score from d"""
SQL["cohen_kappa"] = """
    with b as (select lang as a, main_lang as b from source_files join sites using (site) where lang is not null and main_lang is not null), t as (select count(*) as n, sum(case when a = b then 1 else 0 end) as same from b),
    m as (select label, sum(na) as na, sum(nb) as nb from (select a as label, 1 as na, 0 as nb from b union all select b, 0, 1 from b) group by label), x as (select sum(cast(na as double) * nb) as chance from m)
    select n, round(same / n, 6) as observed, round(chance / (cast(n as double) * n), 6) as expected, round((same / n - chance / (cast(n as double) * n)) / (1 - chance / (cast(n as double) * n)), 6) as kappa from t, x"""
SQL["distinct_context"] = f"""
    with {_index()}, {ASKED}, {_scores('asked')}, {_ranked('asked', 10)}
    select query, doc, rank from (select re.*, row_number() over (partition by query, text order by rank) as n from re join documents d on d.doc_id = re.doc) where n = 1"""
