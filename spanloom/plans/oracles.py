"""DuckDB SQL that gives the same rows as the queries, written from what they mean: offsets from the lengths of what stands between matches, chunks by
recursion, texts by ordered string_agg."""

from __future__ import annotations

from . import queries as Q

#: Fixed values, written out again and not taken from the engine: a wrong one there must not pass on both sides.
PATTERNS = {
    "ID_CARD": r"\p{Nd}{17}[\p{Nd}Xx]",
    "PHONE": r"1[3-9]\p{Nd}{9}",
    "BANK_CARD": r"\p{Nd}{16,19}",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "BIRTHDATE": r"\p{Nd}{4}年\p{Nd}{1,2}月\p{Nd}{1,2}日出生",
    "CASE_NUMBER": r"[\(（]\p{Nd}{4}[\)）][一-龥]{1,6}\p{Nd}{0,4}[一-龥]{1,4}\p{Nd}{1,8}号",
}
ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_CODES = "10X98765432"
ORG_WORDS = ["公司", "集团", "事务所", "银行", "医院", "法院", "学校", "协会", "中心", "厂"]
LABELS = {"PERSON": "人名", "ORG": "机构", "ID_CARD": "身份证", "PHONE": "电话", "BANK_CARD": "银行卡", "EMAIL": "邮箱", "ADDRESS": "地址", "BIRTHDATE": "出生日期", "CASE_NUMBER": "案号"}
OTHER_LABEL = "信息"
RECALL_FLOORS = {"identity": 1.0, "standard": 0.85}
TITLE = "# 脱敏处理报告"
HELD = "⚠️ 有文档需要人工核实,请看下面每份文档的详情,确认无误后再运行「批准并导出」。"
CLEAN = "✅ 所有文档均未发现需要人工核实的内容,可以直接批准导出。"
LEAK_TITLE = "### 🚨 检测到可能的信息残留(独立复查发现,优先处理)"
LEAK_TEXT = "系统在导出前对最终文本做了一次独立复查,发现以下内容可能仍然包含未脱敏的敏感信息。这个检查和上面的正常审核是分开的、更严格的一道关卡——即使其他部分显示「没问题」,这里列出的内容也必须先处理掉才能导出。"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    def cell(x) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "[" + ", ".join(map(cell, x)) + "]::int[]"
        return text(x) if isinstance(x, str) else f"{x}::double" if isinstance(x, float) else str(x)

    return f"(select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as _v({columns}))"


DOCS = "(select source as case_id, doc_id, text from documents)"
FIXTURE = f"(select 'c' as case_id, * from {values(Q.TEXTS, 'doc_id, text')})"
LEXICON = "(select item_id as ord, text as entry from benchmark)"
NAMES = "(select distinct array_to_string(string_split(text, ' ')[1:4], ' ') as name from benchmark)"


def lengths(items: str) -> str:
    return f"cast(coalesce(list_sum(list_transform({items}, lambda x: length(x))), 0) as bigint)"


def matches(source: str, pattern: str) -> str:
    """case_id, doc_id, i, s, e, value: from the lengths of the texts between matches."""
    return f"""(select case_id, doc_id, i, s, s + length(ms[i]) as e, ms[i] as value from (
        select *, {lengths("gs[1:i]")} + {lengths("ms[1:i - 1]")} as s from (
        select *, unnest(range(1, len(ms) + 1)) as i from (
        select case_id, doc_id, regexp_extract_all(text, {text(pattern)}) as ms, string_split_regex(text, {text(pattern)}) as gs from {source}))))"""


def literals(source: str, needles: str, needle: str, also: str) -> str:
    """Occurrences of literals: the parts between them and the literal's own length. also: columns to carry."""
    return f"""(select {also}, i, s, s + length({needle}) as e, {needle} as value from (
        select *, {lengths("gs[1:i]")} + (i - 1) * length({needle}) as s from (
        select *, unnest(range(1, len(gs))) as i from (
        select *, string_split(text, {needle}) as gs from {source} join {needles} on contains(text, {needle}) and {needle} <> ''))))"""


def checksum(value: str) -> str:
    plain = f"translate({value}, '０１２３４５６７８９', '0123456789')"
    total = f"list_sum(list_transform(range(1, 18), lambda k: cast(substr({plain}, k, 1) as int) * ({ID_WEIGHTS})[k]))"
    return f"(upper(substr({plain}, 18, 1)) = substr('{ID_CODES}', cast({total} % 11 as int) + 1, 1))"


def structured(source: str) -> str:
    """Common table expressions up to `structured`: case_id, doc_id, det, i, s, e, entity_type, confidence."""
    raw = ", ".join(f"m_{k.lower()} as {matches(source, p)}" for k, p in PATTERNS.items())
    rest = " union all ".join(f"select case_id, doc_id, {n}, i, s, e, '{k}', 'high' from m_{k.lower()}" for n, k in ((3, "EMAIL"), (4, "BIRTHDATE"), (5, "CASE_NUMBER")))
    inside = "not exists (select 1 from m_id_card d where d.case_id = p.case_id and d.doc_id = p.doc_id and d.s <= p.s and p.e <= d.e)"
    return f"""{raw}, structured as (
        select case_id, doc_id, 0 as det, i, s, e, 'ID_CARD' as entity_type, case when {checksum("value")} then 'high' else 'low' end as confidence from m_id_card
        union all select case_id, doc_id, 1, i, s, e, 'PHONE', 'high' from m_phone p where {inside}
        union all select case_id, doc_id, 2, i, s, e, 'BANK_CARD', 'high' from m_bank_card p where {inside}
        union all {rest})"""


ORG = " or ".join(f"contains(entry, '{w}')" for w in ORG_WORDS)
LEX_SPANS = f"(select case_id, doc_id, ord, i, s, e, case when {ORG} then 'ORG' else 'PERSON' end as entity_type from {literals(DOCS, LEXICON, 'entry', 'case_id, doc_id, ord, entry')})"


def chunked(source: str, size: int, overlap: int) -> str:
    """Recursive common table expression `cut`: doc_id, k, start, stop, n."""
    margin = max(size // 4, overlap + 1)

    def stop(start: str) -> str:
        end, low = f"least({start} + {size}, n)", f"greatest({start}, least({start} + {size}, n) - {margin})"
        part = f"substr(text, {low} + 1, {end} - {low})"
        at = f"({low} + length({part}) - instr(reverse({part}), chr(10) || chr(10)) - 1)"
        return f"case when {start} + {size} < n and instr(reverse({part}), chr(10) || chr(10)) > 0 and {at} > {start} then {at} else {end} end"

    return f"""base as (select case_id, doc_id, text, length(text) as n from {source}),
    cut as (select case_id, doc_id, 0 as k, 0 as start, case when n <= {size} then n else {stop('0')} end as stop, n from base
        union all select c.case_id, c.doc_id, k + 1, ns, {stop('ns').replace(' n)', ' c.n)').replace('< n ', '< c.n ')}, c.n
        from (select *, greatest(stop - {overlap}, start + 1) as ns from cut where stop < n) c join base b on b.doc_id = c.doc_id)"""


ECHO = f"""chunk_text as (select c.case_id, c.doc_id, k, start, substr(b.text, start + 1, stop - start) as text from cut c join base b on b.doc_id = c.doc_id),
    echo as (select case_id, doc_id, k, start + s as s, start + e as e, name, i from {literals('chunk_text', NAMES, 'name', 'case_id, doc_id, k, start, name')})"""

SPANS = f"""with recursive {chunked(DOCS, 3000, 200)}, {ECHO}, {structured(DOCS)},
    spans as (select case_id, doc_id, 0 as src, 'regex' as source, det as o1, i as o2, s, e, entity_type, confidence from structured
        union all select case_id, doc_id, 1, 'lexicon', ord, i, s, e, entity_type, 'high' from {LEX_SPANS}
        union all select case_id, doc_id, 2, 'llm', k, i, s, e, 'ADDRESS', 'low' from echo)"""
ISLANDS = f"""{SPANS}, reach as (select *, max(e) over (partition by doc_id order by s, e, src, o1, o2 rows between unbounded preceding and 1 preceding) as far from spans),
    islands as (select *, sum(case when far is null or s >= far then 1 else 0 end) over (partition by doc_id order by s, e, src, o1, o2 rows unbounded preceding) as island from reach)"""
MERGED = f"""{ISLANDS}, merged as (select * from (select *, row_number() over (partition by doc_id, island order by case confidence when 'high' then 0 else 1 end, e - s, s, e, src, o1, o2) as best from islands) where best = 1)"""
LABEL = "case entity_type " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items()) + f" else '{OTHER_LABEL}' end"
TOKENS = f"""{MERGED}, vals as (select m.case_id, m.doc_id, m.s, m.e, m.entity_type, substr(d.text, m.s + 1, m.e - m.s) as value from merged m join {DOCS} d using (doc_id)),
    firsts as (select *, {LABEL} as label from (select *, row_number() over (partition by case_id, value order by doc_id, s) as r from vals) where r = 1),
    mapping as (select *, '⟦' || label || printf('%03d', num) || '⟧' as token from (select case_id, doc_id, value, label, cast(row_number() over (partition by case_id, label order by doc_id, s) as int) as num from firsts))"""
MASKED = f"""{TOKENS}, gaps as (select v.case_id, v.doc_id, v.s, v.e, m.token, coalesce(lag(v.e) over (partition by v.doc_id order by v.s), 0) as since from vals v join mapping m on m.case_id = v.case_id and m.value = v.value),
    parts as (select g.doc_id, string_agg(substr(d.text, since + 1, s - since) || token, '' order by s) as head, max(e) as last, count(*) as n from gaps g join {DOCS} d using (doc_id) group by g.doc_id),
    masked as (select d.case_id, d.doc_id, case when p.doc_id is null then d.text else head || substr(d.text, last + 1) end as masked_text, cast(coalesce(n, 0) as int) as n_spans from {DOCS} d left join parts p using (doc_id)),
    final as (select case_id, doc_id, masked_text as text from masked)"""
STAGES = f"""{SPANS}, stages as (select d.doc_id, o.ord, o.name, true as ok, cast(case o.ord when 4 then coalesce(l.n, 0) when 6 then coalesce(x.n, 0) else 0 end as bigint) as low_n from {DOCS} d
    cross join (values (0, 'ocr'), (1, '处理台账'), (2, '表格/表单'), (3, '同名待确认'), (4, 'regex'), (5, 'lexicon'), (6, 'llm')) as o(ord, name)
    left join (select doc_id, count(*) as n from structured where confidence = 'low' group by 1) l using (doc_id) left join (select doc_id, count(*) as n from echo group by 1) x using (doc_id))"""
GATE = """gate as (select doc_id, count(r) = 0 as auto_export, coalesce(string_agg(r, '|' order by ord), '') as reasons from (
    select *, case when not ok then name || ' 检测未能正常完成,需人工确认' when low_n > 0 then name || ' 发现 ' || low_n || ' 处需人工核实的疑似内容' end as r from stages) group by doc_id)"""
LATER = structured("final").replace("structured as", "again as").replace("m_", "f_")
LEX_AGAIN = f"(select doc_id, s, e, value from {literals('final', LEXICON, 'entry', 'doc_id, ord, entry')})"
LEAKS = f"""{MASKED}, {LATER}, leaks as (
    select f.doc_id, 1 as check_no, m.value, '「' || m.value || '」的脱敏未完全生效,在最终文本中仍能找到' as message from final f join mapping m on m.case_id = f.case_id and contains(f.text, m.value)
    union all select a.doc_id, 2, substr(f.text, s + 1, e - s), '最终文本中发现疑似残留的敏感信息(' || entity_type || '): 「' || substr(f.text, s + 1, e - s) || '」' from again a join final f using (doc_id)
    union all select doc_id, 3, value, '最终文本中发现「案件人员清单」里的姓名/机构名仍未脱敏: 「' || value || '」' from {LEX_AGAIN})"""
DECIDED = f"""{LEAKS}, stages as {STAGES.split('stages as ')[1]}, {GATE}"""
REPORT = f"""{TOKENS}, stages as {STAGES.split('stages as ')[1]}, {GATE},
    grown as (select case_id, doc_id, cast(sum(n) over (partition by case_id order by doc_id) as bigint) as size from (select d.case_id, d.doc_id, count(m.value) as n from {DOCS} d left join mapping m on m.doc_id = d.doc_id group by 1, 2)),
    section as (select case_id, doc_id, auto_export, doc_id || '.txt' as heading, '## ' || doc_id || '.txt' || chr(10) || case when auto_export then '状态: ✅ 未发现需要人工核实的内容' else '状态: ⚠️ 需要人工核实' || chr(10) || '- ' || replace(reasons, '|', chr(10) || '- ') end
        || chr(10) || '本文档共替换 ' || size || ' 处敏感信息。' as section from grown join gate using (doc_id)),
    report as (select case_id, {text(TITLE)} || chr(10) || chr(10) || case when bool_and(auto_export) then {text(CLEAN)} else {text(HELD)} end || chr(10) || chr(10) || string_agg(section || chr(10), chr(10) order by doc_id) as report from section group by 1)"""
TRUTHS = f"""{MASKED}, second_reach as (select *, max(e) over (partition by doc_id order by s, e, src, o1, o2 rows between unbounded preceding and 1 preceding) as far from spans where src < 2),
    second_islands as (select *, sum(case when far is null or s >= far then 1 else 0 end) over (partition by doc_id order by s, e, src, o1, o2 rows unbounded preceding) as island from second_reach),
    second as (select * from (select *, row_number() over (partition by doc_id, island order by case confidence when 'high' then 0 else 1 end, e - s, s, e, src, o1, o2) as best from second_islands) where best = 1),
    found as (select doc_id, 1 as run, value from vals union all select s.doc_id, 2, substr(d.text, s.s + 1, s.e - s.s) from second s join {DOCS} d using (doc_id)),
    expected as (select distinct cast(doc_id as varchar) as doc, doc_id, category, gt_text from (select doc_id, 'identity' as category, value as gt_text from m_email union all select doc_id, 'identity', value from m_phone
        union all select l.doc_id, 'standard', substr(d.text, l.s + 1, l.e - l.s) from {LEX_SPANS} l join {DOCS} d using (doc_id))),
    hits as (select doc, category, gt_text, coalesce((select bool_and(h) from (select bool_or(contains(f.value, x.gt_text)) as h from found f where f.doc_id = x.doc_id group by f.run)), false) as hit from expected x)"""

RESIDUES = f"(select case_id, cast(doc_id as bigint) as doc_id, text from {values(Q.RESIDUES, 'case_id, doc_id, text')})"
RESIDUE_LEAKS = f"""with {structured(RESIDUES)}, texts as (select * from {RESIDUES}), mapping as (select * from {values(Q.RESIDUE_MAPPING, 'case_id, label, num, token, value')} where value <> ''),
    listed as (select case_id as list_case, ord, entry from {values(Q.RESIDUE_LIST, 'case_id, ord, entry')}),
    leaks as (select t.case_id, t.doc_id, 1 as check_no, m.value, '「' || m.value || '」的脱敏未完全生效,在最终文本中仍能找到' as message from texts t join mapping m on m.case_id = t.case_id and contains(t.text, m.value)
    union all select t.case_id, t.doc_id, 2, substr(t.text, s + 1, e - s), '最终文本中发现疑似残留的敏感信息(' || entity_type || '): 「' || substr(t.text, s + 1, e - s) || '」' from structured x join texts t on t.case_id = x.case_id and t.doc_id = x.doc_id
    union all select case_id, doc_id, 3, value, '最终文本中发现「案件人员清单」里的姓名/机构名仍未脱敏: 「' || value || '」' from {literals('texts', 'listed', 'entry', 'case_id, doc_id, list_case, ord, entry')} where case_id = list_case)"""
GATE_STAGES = f"""with docs as (select * from {values(Q.GATE_DOCS, 'case_id, doc_id')}), pages as (select * from {values(Q.GATE_PAGES, 'case_id, doc_id, source, n_low, possible_table')}),
    own as (select * from {values(Q.GATE_TABLES, 'case_id, doc_id')}), answers as (select * from {values(Q.GATE_ANSWERS, 'case_id, doc_id, ok, n_spans')}), twice as (select * from {values(Q.GATE_NAMES, 'case_id, entry, ord')}), low as (select * from {values(Q.GATE_LOW, 'case_id, doc_id, confidence')}),
    stages as (select d.case_id, cast(d.doc_id as bigint) as doc_id, cast(o.ord as int) as ord, o.name,
        case o.ord when 1 then not exists (select 1 from pages p where p.case_id = d.case_id and p.doc_id = d.doc_id and source = 'failed') when 6 then coalesce((select ok from answers a where a.case_id = d.case_id and a.doc_id = d.doc_id), false) else true end as ok,
        cast(case o.ord when 0 then coalesce((select sum(n_low) from pages p where p.case_id = d.case_id and p.doc_id = d.doc_id and source in ('ocr', 'mixed')), 0)
            when 2 then (select count(*) from pages p where p.case_id = d.case_id and p.doc_id = d.doc_id and possible_table) + (select count(*) from own w where w.case_id = d.case_id and w.doc_id = d.doc_id)
            when 3 then (select count(*) from twice t where t.case_id = d.case_id) when 4 then (select count(*) from low l where l.case_id = d.case_id and l.doc_id = d.doc_id and confidence = 'low')
            when 6 then coalesce((select n_spans from answers a where a.case_id = d.case_id and a.doc_id = d.doc_id), 0) else 0 end as bigint) as low_n
        from docs d cross join (values (0, 'ocr'), (1, '处理台账'), (2, '表格/表单'), (3, '同名待确认'), (4, 'regex'), (5, 'lexicon'), (6, 'llm')) as o(ord, name))"""

OFFSETS = "cast(s as int) as span_start, cast(e as int) as span_end"


def pattern(source: str, kind: str) -> str:
    return f"select doc_id, {OFFSETS}, value from {matches(source, PATTERNS[kind])}"


def oracles() -> dict[str, str]:
    boxes = values([(k, float(x)) for k, v in Q.BOXES.items() for x in v], "page_id, x")
    lines = values(Q.LINES, 'page_id, n, text, confidence, x, y')
    names = values(Q.NAMES, "ord, entry")
    strip = r"'^[\s\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+$'"
    return {
        **{n: pattern(DOCS, k) for n, k in (("span_phone", "PHONE"), ("span_bank", "BANK_CARD"), ("span_email", "EMAIL"))},
        **{n: pattern(FIXTURE, k) for n, k in (("span_phone_fixture", "PHONE"), ("span_bank_fixture", "BANK_CARD"), ("span_email_fixture", "EMAIL"), ("span_id_fixture", "ID_CARD"), ("span_birthdate_fixture", "BIRTHDATE"), ("span_case_number_fixture", "CASE_NUMBER"))},
        "id_checksum_fixture": f"select doc_id, value, {checksum('value')} as valid from {matches(FIXTURE, PATTERNS['ID_CARD'])}",
        "span_structured_fixture": f"with {structured(FIXTURE)} select doc_id, {OFFSETS}, entity_type, confidence from structured",
        "span_suppressed": f"with {structured(DOCS)} select doc_id, {OFFSETS}, entity_type, confidence from structured",
        "span_union": f"{SPANS} select doc_id, source, {OFFSETS}, entity_type, confidence from spans",
        "span_islands": f"{ISLANDS} select doc_id, cast(island as bigint) as island, cast(min(s) as int) as island_start, cast(max(e) as int) as island_end, count(*) as n from islands group by 1, 2",
        "span_merged": f"{MERGED} select doc_id, source, {OFFSETS}, entity_type, confidence from merged",
        "token_mapping": f"{TOKENS} select case_id, label, num, token, value from mapping",
        "masked_text": f"{MASKED} select * from masked",
        "masked_text_incremental": f"{MASKED} select * from masked",
        "restored_text": "select doc_id, text as restored_text from documents",
        "lexicon_spans": f"select doc_id, {OFFSETS}, entity_type from {LEX_SPANS}",
        "lexicon_class": f"select cast(ord as bigint) as ord, case when {ORG} then 'ORG' else 'PERSON' end as entity_type from {names}",
        "lexicon_duplicates": f"select 'c' as case_id, entry, cast(min(ord) as bigint) as ord from (select ord, regexp_replace(entry, {strip}, '', 'g') as entry from {names}) where entry <> '' group by entry having count(*) > 1",
        "chunks": f"with recursive {chunked(DOCS, 3000, 200)} select c.doc_id, k as chunk_no, cast(start as int) as chunk_start, cast(stop - start as int) as n_chars, md5(substr(b.text, start + 1, stop - start)) as chunk_md5 from cut c join base b on b.doc_id = c.doc_id",
        "chunks_paragraph": f"with recursive {chunked("(select 'c' as case_id, page_id as doc_id, replace(html, '</p>', chr(10) || chr(10)) as text from pages)", 1200, 150)} select doc_id, k as chunk_no, cast(start as int) as chunk_start, cast(stop - start as int) as n_chars from cut",
        "entity_spans_echo": f"with recursive {chunked(DOCS, 3000, 200)}, {ECHO} select doc_id, {OFFSETS}, 'ADDRESS' as entity_type, 'low' as confidence from echo",
        "entity_fail_closed": f"with recursive {chunked(DOCS, 3000, 200)}, {ECHO}, bad as (select distinct doc_id from chunk_text where contains(text, '@')) select d.doc_id, b.doc_id is null as ok, case when b.doc_id is null then coalesce(x.n, 0) else 0 end as n_spans from {DOCS} d left join bad b using (doc_id) left join (select doc_id, count(*) as n from echo group by 1) x using (doc_id)",
        "stage_counts": f"{STAGES} select * from stages",
        "export_gate": f"{STAGES}, {GATE} select * from gate",
        "export_gate_fixture": f"with stages as {values(Q.STAGES, 'doc_id, ord, name, ok, low_n')}, {GATE} select cast(doc_id as bigint) as doc_id, auto_export, reasons from gate",
        "stage_counts_fixture": f"{GATE_STAGES} select * from stages",
        "export_gate_cases_fixture": f"{GATE_STAGES}, {GATE.replace('select doc_id, count(r)', 'select case_id, doc_id, count(r)').replace('group by doc_id', 'group by case_id, doc_id')} select * from gate",
        "leak_check_fixture": f"{RESIDUE_LEAKS} select case_id, doc_id, check_no, value, message, count(*) as n from leaks group by all",
        "approve_split_fixture": f"{RESIDUE_LEAKS} select case_id, doc_id, not exists (select 1 from leaks l where l.case_id = t.case_id and l.doc_id = t.doc_id) as approved from texts t",
        "report_leaks_fixture": f"""{RESIDUE_LEAKS}, told as (select case_id, doc_id, string_agg('- ' || message, chr(10) order by message) as found from (select distinct case_id, doc_id, message from leaks) group by 1, 2),
            parts as (select t.case_id, t.doc_id, found is not null as held, '## ' || t.doc_id || '.txt' || chr(10) || case when found is null then '' else {text(LEAK_TITLE)} || chr(10) || {text(LEAK_TEXT)} || chr(10) || found || chr(10) || chr(10) end
            || '状态: ✅ 未发现需要人工核实的内容' || chr(10) || '本文档共替换 2 处敏感信息。' || chr(10) as part from texts t left join told x on x.case_id = t.case_id and x.doc_id = t.doc_id)
            select case_id, {text(TITLE)} || chr(10) || chr(10) || case when bool_or(held) then {text(HELD)} else {text(CLEAN)} end || chr(10) || chr(10) || string_agg(part, chr(10) order by doc_id) as report from parts group by 1""",
        "leak_mapping": f"{MASKED} select d.doc_id, m.value from {DOCS} d join mapping m on m.case_id = d.case_id and contains(d.text, m.value)",
        "leak_regex": f"{MASKED}, {LATER} select doc_id, {OFFSETS}, entity_type from again",
        "leak_lexicon": f"{MASKED} select doc_id, {OFFSETS} from {LEX_AGAIN}",
        "leak_check": f"{LEAKS} select doc_id, check_no, value, message, count(*) as n from leaks group by 1, 2, 3, 4",
        "approve_split": f"{LEAKS} select doc_id, doc_id not in (select doc_id from leaks) as approved from documents",
        "case_all_clean": f"{DECIDED} select case_id, bool_and(auto_export and doc_id not in (select doc_id from leaks)) as all_clean from {DOCS} join gate using (doc_id) group by 1",
        "report_text": f"{REPORT} select * from report",
        "report_sections": f"{REPORT} select case_id, heading, section from section",
        "report_merged": f"select 'c' as case_id, replace(rtrim({text(Q.REPORT_NEW)}, chr(10)), {text(CLEAN)}, {text(HELD)}) || chr(10) || chr(10) || rtrim(substr({text(Q.REPORT_OLD)}, instr({text(Q.REPORT_OLD)}, '## b.txt')), chr(10)) || chr(10) as report",
        "table_flag_fixture": f"""with recursive e as (select page_id, x, row_number() over (partition by page_id order by x) as i, count(*) over (partition by page_id) as n from {boxes}),
            g as (select page_id, i, x as first, 1 as grp, n from e where i = 1 union all select e.page_id, e.i, case when abs(e.x - g.first) <= 0.02 then g.first else e.x end, case when abs(e.x - g.first) <= 0.02 then g.grp else g.grp + 1 end, e.n from g join e on e.page_id = g.page_id and e.i = g.i + 1)
            select page_id, count(*) filter (where size >= 3) >= 2 as possible_table from (select page_id, grp, count(*) as size from g group by 1, 2) group by 1""",
        "reading_order_fixture": f"select cast(page_id as bigint) as page_id, string_agg(text, chr(10) order by -round(y, 3), x, n) as text from {lines} group by 1",
        "ocr_low_conf_fixture": f"select cast(page_id as bigint) as page_id, text, confidence from {lines} where confidence < 0.5",
        "page_router_fixture": f"""with l as (select *, length(regexp_replace(layer, {strip}, '', 'g')) >= 20 as enough, len(list_filter(areas, lambda a: a >= 40000)) > 0 as image from {values(Q.LAYERS, 'page_id, layer, areas')})
            select cast(page_id as bigint) as page_id, case when enough and not image then 'text_layer' when enough then 'mixed' else 'ocr' end as route,
            case when enough and not image then layer when enough then regexp_replace(layer, '\\s+$', '') || chr(10) || chr(10) || '[本页另含图片内容,以下为该图片的 OCR 识别结果]' || chr(10) || '识别' else '识别' end as text from l""",
        "page_concat_fixture": f"select cast(doc_id as bigint) as doc_id, string_agg(chr(10) || chr(10) || '=== 第 ' || page_number || ' 页' || case source when 'ocr' then '(OCR)' when 'mixed' then '(含OCR)' else '' end || ' ===' || chr(10) || text, '' order by page_number) as text from {values(Q.PAGES, 'doc_id, page_number, text, source')} group by 1",
        "case_listing": "select distinct source as case_id from documents",
        "recall_every_run": f"{TRUTHS} select * from hits",
        "recall_by_category": f"{TRUTHS} select category, count(*) filter (where hit) as recalled, count(*) as total, cast(count(*) filter (where hit) as double) / count(*) as recall, cast(count(*) filter (where hit) as double) / count(*) >= case category when 'identity' then {RECALL_FLOORS['identity']} else {RECALL_FLOORS['standard']} end as passed from hits group by 1",
        "over_masking": f"{TRUTHS} select distinct cast(f.doc_id as varchar) as doc, f.value from found f where not exists (select 1 from expected x where x.doc_id = f.doc_id and (contains(f.value, x.gt_text) or contains(x.gt_text, f.value)))",
    }
