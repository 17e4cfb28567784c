"""SQL that recomputes the queries from the given tables, without any of their shortcuts."""

from __future__ import annotations

from .fixtures import FORMS, RECORD
from .stems import with_stems

UTF16_LENGTH = r"length(body) + length(regexp_replace(body, '[^\x{10000}-\x{10FFFF}]', '', 'g'))"

WITH_PAGES = rf"""
with record as (select doc_id as page_id, {RECORD} as value from documents),
parsed as (
  select page_id, split_part(split_part(value, '<title>', 2), '</title>', 1) as title,
         split_part(split_part(value, '<text xml:space="preserve">', 2), '</text>', 1) as body
  from record where not contains(value, '<redirect />')
),
any_page as (
  select page_id, title, body,
         list_transform(regexp_extract_all(body, '(?s)\[\[Category:(.*?)\]\]', 1),
                        lambda c: trim(regexp_replace(upper(c), '\s+', ' ', 'g'))) as categories
  from parsed where {UTF16_LENGTH} >= 2048
),
page as (select * from any_page where len(categories) > 0),
pair as (
  select page_id, len(categories) as n_categories, generate_subscripts(categories, 1) - 1 as pos,
         unnest(categories) as category
  from page
),
weight as (select category, sum(1.0::double / n_categories) as weight from pair group by category)
"""

BENCHMARK_DOCS = "select 'case/' || item_id as filename, text from benchmark"
CONVERSATION_DOCS = """select 'conv/' || conv_id as filename, string_agg(text, chr(10) order by turn) as text
                       from conversations group by conv_id"""

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

_FORM = (
    r"[\p{{L}}\p{{N}}]+(?:[._-][\p{{L}}\p{{N}}]+)*@[\p{{L}}\p{{N}}]+(?:[.-][\p{{L}}\p{{N}}]+)+"
    r"|\p{{L}}+(?:(?:''\p{{L}}+)+|[&@]\p{{L}}+)"
    r"|[\p{{L}}\p{{N}}]+(?:(?:\.[\p{{L}}\p{{N}}]+)+\.?)?"
)
WORD_FORMS = (
    "list_transform(regexp_extract_all(lower({}), '" + _FORM + "'), lambda t: case when contains(t, '@') then t "
    "when contains(t, '''') then regexp_replace(t, '''s$', '') "
    r"when regexp_matches(t, '^(\p{{L}}\.)+$') then replace(t, '.', '') else regexp_replace(t, '\.$', '') end)"
)

EXACT_NORM = "1.0 / sqrt(len)"
BYTE_EXPONENT = "pow(2.0, 2 - floor(log2(1.0 / sqrt(len))))"
BYTE_NORM = f"floor({BYTE_EXPONENT} / sqrt(len)) / {BYTE_EXPONENT}"


def with_index(docs: str, stem_with: str | None = None, rule: str = WORDS) -> str:
    """The index tables; ``stem_with`` names the pages whose words are stemmed as well."""
    words = rule.format("text")
    found, stems = f"select filename, unnest({words}) as term from case_doc", ""
    if stem_with:
        every = f"(select text from case_doc union all select body as text from {stem_with})"
        stems = with_stems(f"select distinct unnest({words}) as term from {every}") + ","
        found = f"select filename, stem as term from ({found}) join stemmed using (term)"
    return f"""
case_doc as ({docs}),{stems}
doc_word as ({found}),
posting as (select term, filename, count(*) as tf from doc_word group by term, filename),
doc_len as (select filename, len({words}) as len from case_doc),
term_stat as (
  select term, count(*) as df, ln((select count(*) from case_doc)::double / (count(*) + 1)) + 1 as idf
  from posting group by term
)"""


def with_terms(pages: str, max_words: int | None = None, stem: bool = False, rule: str = WORDS) -> str:
    found = rule.format("body")
    if max_words is not None:
        found = f"list_slice({found}, 1, {max_words})"
    words = f"select page_id, unnest({found}) as term from {pages}"
    if stem:
        words = f"select page_id, stem as term from ({words}) join stemmed using (term)"
    return f"""
page_word as ({words}),
page_count as (select page_id, term, count(*) as tf from page_word group by page_id, term having count(*) >= 2),
weighed as (
  select page_id, term, tf, idf, tf * idf as weight,
         row_number() over (partition by page_id order by (tf * idf)::real desc, term) as rank
  from page_count join term_stat using (term) where df >= 5
),
asked as (select * from weighed where rank <= 25)"""


def with_hits(norm: str = EXACT_NORM) -> str:
    return f"""
query as (select page_id, count(*) as m, 1 / sqrt(sum(idf * idf)) as qnorm from asked group by page_id),
scored as (
  select page_id, filename,
         any_value(qnorm) * count(*) / any_value(m) * sum(sqrt(tf_doc) * idf * idf * norm) as score
  from (select a.page_id, a.idf, p.filename, p.tf as tf_doc, {norm} as norm
        from asked a join posting p using (term) join doc_len using (filename)) x
  join query using (page_id)
  group by page_id, filename
),
hit as (
  select * from (
    select *, row_number() over (partition by page_id order by score::real desc, filename) as rank from scored
  ) y where rank <= 20
)"""


WITH_SCORES = """
doc_category as (
  select filename, category, sum(score / n_categories / weight) as score
  from hit join pair using (page_id) join weight using (category)
  group by filename, category
),
context as (
  select * from (
    select *, row_number() over (partition by filename order by score::real desc, category) as rank
    from doc_category
  ) z where rank <= 10
)"""

BODIES = f"""{WITH_PAGES} select split_part(split_part(value, '<title>', 2), '</title>', 1) as title,
            md5(split_part(split_part(value, '<text xml:space="preserve">', 2), '</text>', 1)) as digest from record"""
RENDERED = """select filename, string_agg(category || ' (' || printf('%.6f', score) || ')', ' / ' order by rank) as rendered
            from context group by filename"""
PAIRS = "select page_id, pos, category, n_categories from pair"
WEIGHTS = "select category, round(weight, 6) as weight from weight"
CONTEXT = "select filename, rank, category, round(score, 6) as score from context"
SIMILARITY = "select page_id, title, filename, round(score, 6) as score, rank from hit join any_page using (page_id)"
TERMS = "select page_id, rank, term, tf, round(idf, 6) as idf, round(weight, 6) as weight from asked"


def _index(docs: str, select: str) -> str:
    return f"with {with_index(docs)} {select}"


def _from_pages(select: str) -> str:
    return f"{WITH_PAGES} {select}"


def _terms(docs: str, max_words: int | None = None) -> str:
    return f"{WITH_PAGES}, {with_index(docs)}, {with_terms('page', max_words)} {TERMS}"


def _similarity(docs: str, norm: str = EXACT_NORM, stem: bool = False) -> str:
    index = with_index(docs, "any_page" if stem else None)
    return f"{WITH_PAGES}, {index}, {with_terms('any_page', stem=stem)}, {with_hits(norm)} {SIMILARITY}"


def _similarity_of_forms(docs: str) -> str:
    pages = f"formed_page as (select page_id, body || {FORMS.format(id='page_id')} as body from any_page)"
    docs = f"select filename, text || {FORMS.format(id='filename')} as text from ({docs})"
    return f"{WITH_PAGES}, {pages}, {with_index(docs, rule=WORD_FORMS)}, {with_terms('formed_page', rule=WORD_FORMS)}, {with_hits()} {SIMILARITY}"


def _scores(docs: str, select: str, stem: bool = False) -> str:
    index = with_index(docs, "page" if stem else None)
    return f"{WITH_PAGES}, {index}, {with_terms('page', stem=stem)}, {with_hits()}, {WITH_SCORES} {select}"


def oracle_sql(max_record_bytes: int) -> dict[str, str]:
    bench, conv = BENCHMARK_DOCS, CONVERSATION_DOCS
    context = _scores(bench, CONTEXT)
    return {
        "eligible_pages": _from_pages("select page_id, length(body) as n_chars, len(categories) as n_categories from page"),
        "page_source_roundtrip": f"""{WITH_PAGES} select split_part(split_part(value, '<title>', 2), '</title>', 1) as title,
            md5(split_part(split_part(value, '<text xml:space="preserve">', 2), '</text>', 1)) as digest,
            strlen(value) as n_bytes from record""",
        "page_source_bzip2": BODIES,
        "page_source_revisions": BODIES,
        "page_source_preamble": f"""{WITH_PAGES}, nested as (
              select replace(value, '    <revision>', '    <revision>' || chr(10) || '  <page>') as value from record)
            select split_part(split_part(value, '<title>', 2), '</title>', 1) as title, md5(value) as digest, strlen(value) as n_bytes
            from nested, range(2)""",
        "oversize_records_dropped": f"""{WITH_PAGES} select split_part(split_part(value, '<title>', 2), '</title>', 1) as title,
            strlen(value) as n_bytes from record where strlen(value) <= {max_record_bytes}""",
        "case_documents_roundtrip": f"with d as ({conv}) select length(text) as n_chars, md5(text) as digest from d",
        "page_titles": """select page_id, split_part(split_part(html, '<title>', 2), '</title>', 1) as title
            from pages where contains(html, '</title>')""",
        "page_category_pairs": _from_pages(PAIRS),
        "page_category_pairs_no_sort_key": _from_pages(
            """select page_id, pos, trim(split_part(category, '|', 1)) as category, n_categories from pair"""
        ),
        "category_weights": _from_pages(WEIGHTS),
        "weights_export_roundtrip": _from_pages(WEIGHTS),
        "tokens": f"""with w as (select item_id, {WORDS.format('text')} as w from benchmark)
            select 'case/' || item_id as filename, generate_subscripts(w, 1) - 1 as pos, unnest(w) as term from w""",
        "tokens_word_forms": f"""with w as (select doc_id, {WORD_FORMS.format(f"text || {FORMS.format(id='doc_id')}")} as w from documents where text is not null)
            select doc_id, generate_subscripts(w, 1) - 1 as pos, unnest(w) as term from w""",
        "page_similarity_word_forms": _similarity_of_forms(conv),
        "postings": _index(bench, "select term, filename, tf from posting"),
        "postings_conversations": _index(conv, "select term, filename, tf from posting"),
        "term_stats": _index(bench, "select term, df, round(idf, 6) as idf from term_stat"),
        "term_stats_conversations": _index(conv, "select term, df, round(idf, 6) as idf from term_stat"),
        "index_terms": _index(conv, "select term, df, round(idf, 6) as idf from term_stat"),
        "index_postings": _index(conv, f"""select term, filename, round(sqrt(tf) * idf * idf * {EXACT_NORM}, 6) as impact
            from posting join term_stat using (term) join doc_len using (filename)"""),
        "doc_stats": _index(bench, "select filename, len from doc_len"),
        "stem_vocabulary": f"""with {with_stems(f"select distinct unnest({WORDS.format('text')}) as term from documents")}
            select term, stem from stemmed""",
        "page_similarity_stemmed": _similarity(conv, stem=True),
        "document_context_stemmed": _scores(conv, CONTEXT, stem=True),
        "query_terms": _terms(bench),
        "query_terms_whole_text": _terms(conv),
        "page_similarity": _similarity(bench),
        "page_similarity_byte_norm": _similarity(bench, BYTE_NORM),
        "page_similarity_conversations": _similarity(conv),
        "page_similarity_bounded_lists": _similarity(conv),
        "page_similarity_many_shards": _similarity(conv),
        "document_category_scores": _scores(bench, "select filename, category, round(score, 6) as score from doc_category"),
        "document_context": context,
        "document_context_conversations": _scores(conv, CONTEXT),
        "document_context_rendered": _scores(bench, RENDERED),
        "context_run_reuse": context,
    }
