"""The registered queries restated as DuckDB SQL over the same tables."""

from __future__ import annotations

from docketry import fixed_values as fixed
from docketry.functions.text import WHITESPACE
from docketry.operators.models import TERM_PATTERN
from docketry.params import FAST, NORMAL

from . import views
from .views import AS_OF_YEAR as YEAR

BASE_URL = "https://decisions.example/"


def q(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def pick(values: list[str], id_: str) -> str:
    items = ", ".join(q(v) for v in values)
    return f"([{items}])[({id_}) % {len(values)} + 1]"


def strip(x: str) -> str:
    return f"trim({x}, {q(WHITESPACE)})"


def r6(x: str) -> str:
    return f"round({x}, 6)"


NL = q("\n")
MARK = q(r"\[\d+\]")

# --- the synthetic decision view ----------------------------------------------------
_quarter = "(length(text) // 4)"
_piece = [f"substring(text, {i} * {_quarter} + 1, {_quarter})" for i in range(3)]
_piece.append(f"substring(text, 3 * {_quarter} + 1, length(text))")
_structured = " || ".join([
    f"CASE WHEN doc_id % 4 = 0 THEN {q(views.BRIDGE)} ELSE '' END",
    "'Decision [1] The appeal is '", pick(views.OUTCOMES, "doc_id"), q(".\n"),
    q("Overview\n[2] "), _piece[0], NL,
    pick(views.ISSUES, "doc_id"), "' [3] '", _piece[1], NL,
    pick(views.ANALYSES, "doc_id"), "' [4] '", pick(views.PHRASES, "doc_id"), q("\n[5] "),
    _piece[2], q("\n[6] "), _piece[3], NL,
    "'Conclusion [7] '", pick(views.PHRASES, "doc_id + 1"), NL,
    f"CASE WHEN doc_id % 5 = 0 THEN {q(views.FOOTNOTES)} ELSE '' END"])
DECISIONS = f"""decisions AS (
  SELECT doc_id AS pos, {q(BASE_URL)} || doc_id AS url, source || ' v ' || doc_id AS name,
    CASE WHEN doc_id % 17 <> 0 THEN ({YEAR} - doc_id % 20)::VARCHAR || '-01-15' END
      AS document_date,
    {q(views.HEADER)} || source || ' v ' || doc_id || {q(views.CONTENTS)}
      || CASE WHEN doc_id % 11 = 0 THEN text ELSE {_structured} END AS text
  FROM documents)"""
VECTORS = f"""vectors AS (
  SELECT vec_id AS pos, {q(BASE_URL)} || vec_id AS url, embedding FROM embeddings)"""

# --- sections ---------------------------------------------------------------------------
_toc = r"(?s)\A.*?On this page(?:[^\n]*\n[^\n]*\n|[^\n]*\n|)"
_head = rf"(?m)^({fixed.HEADING_PATTERN})(\s*)(\[\d+\])"


def sections_of(source: str) -> str:
    """CTEs from a table with url and text to ``cleaned`` and ``secs``."""
    return f"""
  s1 AS (SELECT url, text AS raw, CASE WHEN strpos(text, 'Decision Content') > 0
      THEN substring(text, strpos(text, 'Decision Content') + 16) ELSE text END AS t
      FROM {source}),
  s2 AS (SELECT url, raw, regexp_replace(regexp_replace(t, {q(_toc)}, ''),
      '\\A\\s*Reasons and decision\\s*', '') AS t FROM s1),
  cleaned AS (SELECT url, raw, {strip(f"split_part(t, {q(fixed.FOOTNOTE_START)}, 1)")} AS body
      FROM s2),
  cut AS (SELECT url, string_split(regexp_replace(body, {q(_head)},
      chr(1) || '\\1' || chr(2) || '\\2\\3', 'g'), chr(1)) AS parts FROM cleaned),
  part AS (SELECT url, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM cut),
  named AS (SELECT url, {strip("split_part(p, chr(2), 1)")} AS name,
      {strip("replace(p, chr(2), '')")} AS text,
      (row_number() OVER (PARTITION BY url ORDER BY i) - 1)::INT AS ord
      FROM part WHERE contains(p, chr(2))),
  every AS (SELECT * FROM named UNION ALL
      SELECT url, 'body', body, 0 FROM cleaned c WHERE body <> '' AND NOT EXISTS
      (SELECT 1 FROM named n WHERE n.url = c.url)),
  secs AS (SELECT *, CASE {" ".join(
      f"WHEN regexp_matches(name, {q('(?i)' + p)}) THEN {i}"
      for i, p in enumerate(fixed.PRIORITY_PATTERNS, 1))} ELSE 7 END AS priority FROM every)"""


def cut_analysis(text: str, room: str) -> str:
    """Head and tail of a priority-one section in ``room`` characters."""
    marks, parts = f"regexp_extract_all({text}, {MARK})", f"string_split_regex({text}, {MARK})"
    tail = (f"right({text}, (length({parts}[-1]) + length({marks}[-1])"
            f" + length({parts}[-2]) + length({marks}[-2]))::INT)")
    return (f"CASE WHEN length({text}) <= {room} THEN {text}"
            f" WHEN {room} < 8 OR len({marks}) < 3 THEN left({text}, {room})"
            f" ELSE left({text}, {room} - {room} // 5 - 7) || ' [...] '"
            f" || left({tail}, {room} // 5) END")


def packed_of(name: str, budget: int, strict: bool = False) -> str:
    """A CTE ``name`` (url, packed) over ``cleaned`` and ``secs``; greedy part by recursion."""
    extra = "+ length(name) + 3" if strict else ""
    room = "(f.room - length(o.name) - 5)"
    piece = (f"CASE WHEN length(o.text) <= {room} THEN o.text"
             f" WHEN o.priority = 1 THEN {cut_analysis('o.text', room)}"
             f" ELSE left(o.text, {room}) END")
    return f"""
  {name}_n AS (SELECT url, sum(length(text) {extra}) + 2 * (count(*) - 1) AS total
      FROM secs GROUP BY url),
  {name}_o AS (SELECT s.*, row_number() OVER (PARTITION BY url ORDER BY priority, ord) AS rn
      FROM secs s JOIN {name}_n USING (url) WHERE total > {budget}),
  {name}_f AS (
    SELECT DISTINCT url, 0::BIGINT AS rn, {budget}::BIGINT AS room, -1 AS ord, '' AS piece
      FROM {name}_o
    UNION ALL
    SELECT url, rn, left_over - length(piece), ord, label || piece FROM (
      SELECT o.url, o.rn, o.ord, '[' || o.name || '] ' AS label, {room} AS left_over,
        {piece} AS piece
      FROM {name}_f f JOIN {name}_o o ON o.url = f.url AND o.rn = f.rn + 1
      WHERE {room} > 0)),
  {name} AS (
    SELECT url, string_agg('[' || name || '] ' || text, {q(chr(10) * 2)} ORDER BY ord) AS packed
      FROM secs JOIN {name}_n USING (url) WHERE total <= {budget} GROUP BY url
    UNION ALL
    SELECT url, coalesce(string_agg(piece, {q(chr(10) * 2)} ORDER BY ord)
      FILTER (ord >= 0), '') FROM {name}_f GROUP BY url
    UNION ALL
    SELECT url, left(raw, {budget}) FROM cleaned WHERE body = '')"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


SECTIONS = (DECISIONS, sections_of("decisions"))

# --- authority ------------------------------------------------------------------------------


def year_of(x: str) -> str:
    return f"nullif(regexp_extract({x}, {q(fixed.YEAR_PATTERN)}), '')::INT"


def recency_of(year: str) -> str:
    return (f"CASE WHEN {year} IS NULL THEN 0.5::DOUBLE ELSE"
            f" exp(-ln(2) * greatest(0, {YEAR} - {year}) / 7.0::DOUBLE) END")


def recency_label_of(year: str) -> str:
    return (f"CASE WHEN {year} IS NULL THEN 'Unknown' WHEN {YEAR} - {year} <= 5 THEN 'Recent'"
            f" WHEN {YEAR} - {year} <= 12 THEN 'Older' ELSE 'Historical' END")


def relevance_of(score: str) -> str:
    return (f"CASE WHEN {score} >= 0.65 THEN 'High' WHEN {score} >= 0.35 THEN 'Medium'"
            f" ELSE 'Low' END")


def risk_of(year: str, score: str) -> str:
    age = f"coalesce({YEAR} - {year}, 999)"
    return (f"CASE WHEN {age} > 12 OR {score} < 0.35 THEN 'Verify'"
            f" WHEN {age} > 5 OR {score} < 0.65 THEN 'Medium' ELSE 'Low' END")


def citations_of(x: str) -> str:
    return f"len(regexp_extract_all(lower({x}), {q(fixed.CITATION_PATTERN)}))"


def reasoning_of(x: str) -> str:
    return "(" + " + ".join(f"regexp_matches(lower({x}), {q(p)})::INT"
                            for p in fixed.REASONING_PATTERNS) + ")"


def grounding_of(x: str) -> str:
    return (f"least(1.0::DOUBLE, 0.75::DOUBLE"
            f" + CASE WHEN regexp_matches(lower({x}), '\\banalysis\\b') THEN 0.05::DOUBLE"
            f" ELSE 0.0::DOUBLE END"
            f" + least(0.10::DOUBLE, {citations_of(x)} * 0.01::DOUBLE)"
            f" + least(0.10::DOUBLE, {reasoning_of(x)} * 0.02::DOUBLE))")


def outcome_of(x: str) -> str:
    head = f"lower(left({x}, 800))"
    yes, no = (f"regexp_matches({head}, '\\bappeal is {w}\\b')" for w in ("allowed", "dismissed"))
    return (f"CASE WHEN {yes} AND NOT {no} THEN 'Allowed'"
            f" WHEN {no} AND NOT {yes} THEN 'Dismissed' ELSE 'Unknown' END")


# --- vectors ----------------------------------------------------------------------------------


def norm_of(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"


def normalized(v: str) -> str:
    return f"list_transform({v}, lambda x: (x::DOUBLE / greatest({norm_of(v)}, 1e-12))::FLOAT)"


def digest(v: str) -> str:
    return (f"round({norm_of(v)}, 5) AS norm,"
            f" round(list_sum(list_transform({v}, lambda x: x::DOUBLE)), 4) AS total,"
            f" round({v}[1]::DOUBLE, 5) AS first")


DAMAGED = """damaged AS (SELECT vec_id, list_transform(embedding, lambda x:
  CASE WHEN x < -0.3 THEN 'nan'::FLOAT WHEN x > 0.3 THEN 'inf'::FLOAT ELSE x END) AS v
  FROM embeddings)"""
BAD = "list_filter(v, lambda x: NOT isfinite(x))"
REPAIRED = f"""{DAMAGED}, repaired AS (SELECT vec_id,
  list_transform(v, lambda x: CASE WHEN isfinite(x) THEN x ELSE 0::FLOAT END) AS v FROM damaged)"""


def hits_of(queries: str, vectors: str, k: int) -> str:
    """CTEs from (query_id, v) and (url, v), both normalised, to ``hits``."""
    return f"""
  scored AS (SELECT query_id, url, round(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]), 9)
      AS score FROM {queries} a CROSS JOIN {vectors} b),
  hits AS (SELECT query_id, url, score, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, url) AS rank FROM scored QUALIFY rank <= {k})"""


UNIT = f"""unit AS (SELECT vec_id, {q(BASE_URL)} || vec_id AS url,
  {normalized("embedding")} AS v FROM embeddings)"""
SELF_HITS = (UNIT, "asked AS (SELECT vec_id AS query_id, v FROM unit)",
             hits_of("asked", "unit", NORMAL.stage1_top_k))


def encoded(name: str, source: str, key: str, text: str) -> str:
    """CTEs of the hashed-term stand-in: ``name`` (key, v), counts per place, raw."""
    return f"""
  {name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), {q(TERM_PATTERN)})) AS t
      FROM {source}),
  {name}_c AS (SELECT {key}, ('0x' || substr(md5(t), 1, 4))::INT % 64 AS b, count(*) AS c
      FROM {name}_t GROUP BY ALL),
  {name} AS (SELECT d.{key}, list(coalesce(c, 0)::FLOAT ORDER BY i) AS v
      FROM {source} d CROSS JOIN range(64) r(i)
      LEFT JOIN {name}_c c ON c.{key} = d.{key} AND c.b = r.i GROUP BY d.{key})"""


DOC_VECTORS = f"""{encoded("doc_raw", "documents", "doc_id", "text")},
  doc_vec AS (SELECT doc_id AS pos, {q(BASE_URL)} || doc_id AS url, {normalized("v")} AS v
    FROM doc_raw)"""
_prompt = q(f"Instruct: {fixed.EMBEDDING_INSTRUCTION}\nQuery:")
TEXT_QUERIES = f"""asked_text AS (SELECT conv_id * 1000 + turn AS query_id, text AS query,
    {_prompt} || text AS shown FROM conversations WHERE role = 'user'),
  {encoded("asked_raw", "asked_text", "query_id", "shown")},
  asked AS (SELECT query_id, {normalized("v")} AS v FROM asked_raw)"""


def terms_of(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), {q(TERM_PATTERN)}))"


def overlap_of(query: str, document: str) -> str:
    return (f"CASE WHEN len({terms_of(query)}) > 0 THEN len(list_intersect({terms_of(query)},"
            f" {terms_of(document)}))::DOUBLE / len({terms_of(query)}) ELSE 0.0::DOUBLE END")


def landscape_of(source: str) -> str:
    """CTEs from assessed rows to ``chosen`` with rank and role."""
    return f"""
  sided AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n,
      row_number() OVER (PARTITION BY query_id, outcome ORDER BY authority_rank) AS side
      FROM {source}),
  slotted AS (SELECT *, CASE WHEN outcome = 'Allowed' AND side = 1 THEN 1
      WHEN outcome = 'Dismissed' AND side = 1 THEN 2 WHEN outcome = 'Unknown' THEN 3
      ELSE 4 END AS slot FROM sided),
  chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY slot, authority_rank)
      AS rank, CASE WHEN n < 2 THEN '' WHEN outcome = 'Allowed' THEN 'supportive'
      WHEN outcome = 'Dismissed' THEN 'unsupportive' ELSE 'context' END AS landscape_role
      FROM slotted QUALIFY rank <= 3)"""


def search_ctes(params) -> tuple[str, ...]:
    year = year_of("document_date")
    return (
        DECISIONS, sections_of("decisions"), packed_of("pk", params.pack_chars), DOC_VECTORS,
        TEXT_QUERIES, hits_of("asked", "doc_vec", params.stage1_top_k),
        f"""pairs AS (SELECT h.query_id, h.url, h.rank AS stage1_rank,
            {overlap_of("query", "packed")} AS reranker_score
            FROM hits h JOIN asked_text USING (query_id) JOIN pk USING (url)),
          top AS (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY reranker_score DESC, stage1_rank) AS stage2_rank FROM pairs
            QUALIFY stage2_rank <= {params.stage2_top_k}),
          signals AS (SELECT query_id, url, name, document_date AS date, text, stage2_rank,
            reranker_score, {recency_of(year)} AS recency_factor,
            {grounding_of("text")} AS grounding_factor,
            {relevance_of("reranker_score")} AS relevance_label,
            {recency_label_of(year)} AS recency_label,
            {risk_of(year, "reranker_score")} AS authority_risk, {outcome_of("text")} AS outcome
            FROM top JOIN decisions USING (url)),
          assessed AS (SELECT *, reranker_score * recency_factor * grounding_factor
            AS authority_score, row_number() OVER (PARTITION BY query_id ORDER BY
            reranker_score * recency_factor * grounding_factor DESC, stage2_rank)
            AS authority_rank FROM signals)""")


_RESULT = f"""SELECT query_id, rank, name, date, url, left(text, 500) AS snippet,
  md5(text) AS text_md5, {r6("reranker_score")} AS reranker_score,
  {r6("authority_score")} AS authority_score, {r6("recency_factor")} AS recency_factor,
  {r6("grounding_factor")} AS grounding_factor, relevance_label, recency_label, authority_risk,
  outcome, landscape_role FROM """
_TURNS = f"""turns AS (SELECT conv_id AS query_id, 'turn-' || conv_id || '-' || turn AS url,
    ({YEAR} - (conv_id * 7 + turn * 3) % 16)::VARCHAR || '-05-01' AS date,
    'The appeal is ' || {pick(["allowed", "dismissed", "heard"], "conv_id * 7 + turn * 3")}
      || '. ' || text AS text,
    ((conv_id * 7 + turn * 3) % 11) / 10.0::DOUBLE AS reranker_score, turn + 1 AS stage2_rank
    FROM conversations),
  signals AS (SELECT *, reranker_score * {recency_of(year_of("date"))} * {grounding_of("text")}
    AS authority_score, {outcome_of("text")} AS outcome FROM turns),
  assessed AS (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY authority_score DESC, stage2_rank) AS authority_rank FROM signals)"""
_DIVERSE = ("(count(*) FILTER (outcome <> 'Unknown') < 2"
            " OR count(DISTINCT outcome) FILTER (outcome <> 'Unknown') > 1)")

# --- glossary and cards -------------------------------------------------------------------------
_any_term = "|".join(term for term, _, _ in fixed.GLOSSARY)
GLOSSARY = "glossary AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(t)}, {q(d)}, {q(c)})" for t, d, c in fixed.GLOSSARY) + ") g(term, definition, context))"
TERMS = f"""found AS (SELECT url, unnest(m) AS term, generate_subscripts(m, 1) AS i FROM (
    SELECT url, regexp_extract_all(lower(text), {q(rf"\b({_any_term})\b")}) AS m
    FROM decisions)),
  terms AS (SELECT url, term, row_number() OVER (PARTITION BY url ORDER BY min(i)) - 1 AS ord
    FROM found GROUP BY url, term)"""
_HEADS = {"Issue": "2", "Key Facts": "4, 6", "Test Applied": "1, 5", "Outcome": "3"}


def cards(grounded: bool) -> str:
    """CTEs from ``secs`` to ``parts`` (url, head, n, bullets) and ``card`` (url, card)."""
    marks = f"regexp_extract_all(text, {q(r'\[(\d+)\]')}, 1)"
    ref = (f"CASE WHEN len({marks}) > 0 THEN 'para ' || {marks}[1] || '-' || {marks}[-1]"
           f" || ' | explicit' ELSE 'general context | inferred' END")
    bullet = f"'- ' || text || {q(chr(10) + '  [Source: ')} || {ref} || ']'" if grounded else (
        "'- ' || text")
    heads = " UNION ALL ".join(
        f"SELECT d.url, {q(h)} AS head, {n} AS n, coalesce((SELECT string_agg({bullet}, {NL}"
        f" ORDER BY ord) FROM secs s WHERE s.url = d.url AND priority IN ({p})), '') AS bullets"
        f" FROM cleaned d" for n, (h, p) in enumerate(_HEADS.items()))
    whole = f"string_agg('**' || head || ':**' || {NL} || bullets, {NL} ORDER BY n)"
    return f"""parts AS ({heads}),
  card AS (SELECT url, {strip(whole)} AS card FROM parts GROUP BY url)"""


_CLAIM_ROWS = f"""claims AS (SELECT s.url, h.head AS section,
    row_number() OVER (PARTITION BY s.url, h.head ORDER BY ord) - 1 AS ord, text,
    regexp_extract_all(text, {q(r"\[(\d+)\]")}, 1) AS marks
  FROM secs s JOIN (VALUES ('Issue', 2), ('Key Facts', 4), ('Key Facts', 6), ('Test Applied', 1),
    ('Test Applied', 5), ('Outcome', 3)) h(head, p) ON h.p = s.priority)"""

_CHUNKED = """ordered AS (SELECT pos, url, length(text) AS length,
    greatest(1, (length(text) + 3) // 4) AS tokens,
    row_number() OVER (ORDER BY length(text), pos) - 1 AS idx FROM decisions),
  chunked AS (SELECT *, idx // 500 AS chunk_id FROM ordered)"""
_DELTA = f"""{DECISIONS}, {VECTORS}, {encoded("raw", "decisions", "pos", "text")},
  fresh AS (SELECT pos AS doc, url, (SELECT max(pos) + 1 FROM vectors)
      + row_number() OVER (ORDER BY length(text), pos) - 1 AS pos
      FROM decisions WHERE url NOT IN (SELECT url FROM vectors)),
  store AS (SELECT url, pos, embedding AS v FROM vectors UNION ALL
      SELECT url, f.pos, v FROM fresh f JOIN raw ON raw.pos = f.doc)"""
_EVERY_DECISION = f"WITH {DECISIONS} SELECT "

_result_url = "CASE WHEN pos % 3 <> 0 THEN url ELSE '' END"
_result_key = (f"coalesce(nullif({_result_url}, ''), 'rank-1:' || name || ':' ||"
               " coalesce(document_date, ''))")


def _card_prompt(system: str, n: int) -> str:
    start = q(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"
              "Here is the tribunal decision:\n\n")
    end = q("<|im_end|>\n<|im_start|>assistant\n")
    return f"md5({start} || left(text, {n}) || {end})"


# The best result of every query, among those the landscape chose.
_BEST = """best AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY query_id
    ORDER BY authority_score DESC, rank) = 1)"""
_SCORE = "((pos % 101) / 100.0::DOUBLE)"
_YEAR = year_of("document_date")

ORACLES = {
    "read_decisions": _EVERY_DECISION + "url, name, document_date, md5(text) AS text_md5"
    " FROM decisions",
    "read_vectors": f"WITH {VECTORS} SELECT url, pos, {r6(norm_of('embedding'))} AS norm"
    " FROM vectors",
    "dev_limit": _EVERY_DECISION + "pos, url FROM decisions ORDER BY pos LIMIT 500",
    "drop_blank_text": f"""SELECT doc_id, count(*) AS n_lines FROM (
        SELECT doc_id, unnest(string_split(text, {NL})) AS line FROM documents)
        WHERE {strip('line')} <> '' GROUP BY doc_id""",
    "add_position": "SELECT doc_id, n_chars,"
    " row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos FROM documents",
    "candidate_projection": "SELECT 'doc-' || doc_id AS url, 'Unnamed' AS name,"
    " strftime(DATE '2000-01-01' + (doc_id % 9000)::INT, '%Y-%m-%d') AS document_date,"
    " length(text) AS n FROM documents",
    "snippet": "SELECT doc_id, left(text, 500) AS snippet, left(text, 500) ||"
    " CASE WHEN length(text) > 500 THEN '...' ELSE '' END AS shown FROM documents",
    "score_percent": "SELECT event_id,"
    " printf('%.1f%%', (event_id % 997) / 1024.0::DOUBLE * 100) AS percent FROM events",
    "estimate_tokens": "SELECT doc_id, greatest(1, (length(text) + 3) // 4) AS tokens"
    " FROM documents",
    "truncate_text": "SELECT doc_id, md5(left(text, 32768)) AS cut_md5,"
    " length(text) > 32768 AS truncated FROM documents",
    "prompts": f"""SELECT conv_id, turn, {_prompt} || text AS embed,
        {q(fixed.RERANKER_INSTRUCTION)} || {NL} || text AS rerank,
        '<Instruct>: ' || {q(fixed.RERANKER_INSTRUCTION)} || {q(chr(10) + '<Query>: ')} || text
          || {q(chr(10) + '<Document>: ')} || text AS pair
        FROM conversations WHERE role = 'user'""",
    "card_prompts": _EVERY_DECISION + f"""url, {_card_prompt(fixed.CARD_PROMPT, 24000)}
        AS card_md5, {_card_prompt(fixed.GROUNDED_CARD_PROMPT, 12000)} AS grounded_md5
        FROM decisions""",
    "result_key": _EVERY_DECISION + f"""pos, {_result_key} AS key,
        {_result_key} || '|backend=local|fast_mode=True' AS full_key FROM decisions""",
    "sanitize_normalize": f"WITH {REPAIRED}, done AS (SELECT vec_id, {normalized('v')} AS v"
    f" FROM repaired) SELECT vec_id, {digest('v')} FROM done",
    "sanitize_normalize_columns": f"WITH {REPAIRED}, done AS (SELECT vec_id,"
    f" {normalized('v')} AS v FROM repaired) SELECT vec_id, {digest('v')} FROM done",
    "sanitize_rows": f"WITH {DAMAGED}, done AS (SELECT vec_id, CASE WHEN len({BAD}) > 0"
    f" THEN list_transform(v, lambda x: 0::FLOAT) ELSE v END AS v FROM damaged)"
    f" SELECT vec_id, {digest('v')} FROM done",
    "vector_quality": f"WITH {DAMAGED} SELECT sum(len({BAD}))::BIGINT AS bad_values,"
    f" count(*) FILTER (len({BAD}) > 0) AS bad_rows FROM damaged",
    "clamp_score": f"""WITH {DAMAGED}, s AS (SELECT vec_id, CASE WHEN len({BAD}) > 0 THEN -1.0
        ELSE list_dot_product(v::DOUBLE[], v::DOUBLE[]) END AS s FROM damaged)
        SELECT vec_id, {r6('s')} AS score FROM s""",
    "yes_no_probability": f"""SELECT vec_id, {r6('''exp(embedding[1]::DOUBLE * 10)
        / (exp(embedding[1]::DOUBLE * 10) + exp(embedding[2]::DOUBLE * 10))''')} AS p
        FROM embeddings""",
    "embedding_profile": f"""WITH e AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT (SELECT count(*) FROM embeddings) AS n_rows,
        (SELECT max(len(embedding)) FROM embeddings) AS dim, 'float32' AS dtype,
        {r6('max(x)')} AS max, {r6('min(x)')} AS min, {r6('avg(x)')} AS mean,
        bool_or(isnan(x)) AS any_nan, bool_or(isinf(x)) AS any_inf,
        count(*) FILTER (abs(x) > 0 AND abs(x) < 1e-30) AS n_tiny,
        (SELECT string_agg(printf('%.4f', n), ',' ORDER BY vec_id) FROM (
          SELECT vec_id, {norm_of('embedding')} AS n FROM embeddings ORDER BY vec_id LIMIT 10))
        AS first_norms FROM e""",
    "cosine_topk": with_(*SELF_HITS) + "SELECT query_id, url, rank AS stage1_rank,"
    " score AS stage1_score FROM hits",
    "cosine_topk_single": with_(UNIT, f"""mean AS (SELECT list(m::FLOAT ORDER BY i) AS m FROM (
        SELECT i, avg(x::DOUBLE) AS m FROM (SELECT unnest(embedding) AS x,
        generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)),
        asked AS (SELECT 0 AS query_id, {normalized('m')} AS v FROM mean)""",
        hits_of("asked", "unit", 40)) + "SELECT url, score AS stage1_score FROM hits",
    "hit_lookup": with_(DECISIONS, *SELF_HITS) + """SELECT query_id, rank AS stage1_rank, url,
        name, document_date, length(text) AS n FROM hits JOIN decisions USING (url)""",
    "search_normal": with_(*search_ctes(NORMAL)) + _RESULT + """(SELECT *,
        authority_rank AS rank, '' AS landscape_role FROM assessed)""",
    "search_fast": with_(*search_ctes(FAST), landscape_of("assessed")) + _RESULT + "chosen",
    "search_summary": with_(*search_ctes(FAST)) + f"""SELECT query_id, 'ok' AS status,
        n_hits, outcome_diversity, n >= 2 AS landscape_mode FROM (
        SELECT query_id, count(*) AS n, {_DIVERSE} AS outcome_diversity
        FROM assessed GROUP BY query_id) JOIN (
        SELECT query_id, count(*) AS n_hits FROM hits GROUP BY query_id) USING (query_id)""",
    "rerank_topk": f"""SELECT query_id, url, stage2_rank, {r6('score')} AS reranker_score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url)
          AS stage2_rank FROM (
        SELECT t.conv_id AS query_id, t.turn AS url, {overlap_of('f.text', 't.text')} AS score
        FROM conversations t JOIN conversations f ON f.conv_id = t.conv_id AND f.turn = 0)
        QUALIFY stage2_rank <= 3)""",
    "authority_rerank": f"WITH {_TURNS} SELECT query_id, url, authority_rank,"
    f" {r6('authority_score')} AS authority_score FROM assessed",
    "landscape": f"WITH {_TURNS}, {landscape_of('assessed')}"
    " SELECT query_id, url, rank, outcome, landscape_role FROM chosen",
    "diversity": f"WITH {_TURNS} SELECT query_id, {_DIVERSE} AS outcome_diversity"
    " FROM assessed GROUP BY query_id",
    "parse_year": _EVERY_DECISION + f"url, {_YEAR} AS date_year, {year_of('text')} AS text_year"
    " FROM decisions",
    "recency": _EVERY_DECISION + f"url, {r6(recency_of(_YEAR))} AS factor,"
    f" {recency_label_of(_YEAR)} AS label FROM decisions",
    "labels": _EVERY_DECISION + f"url, {relevance_of(_SCORE)} AS relevance,"
    f" {risk_of(_YEAR, _SCORE)} AS risk FROM decisions",
    "grounding": _EVERY_DECISION + f"url, {citations_of('text')} AS citations,"
    f" {reasoning_of('text')} AS reasoning, {r6(grounding_of('text'))} AS factor FROM decisions",
    "outcome": _EVERY_DECISION + f"url, {outcome_of('text')} AS outcome FROM decisions",
    "assess": f"""WITH {DECISIONS}, a AS (SELECT url, {_SCORE} AS s, {_YEAR} AS y,
        {recency_of(_YEAR)} AS r, {grounding_of('text')} AS g, {outcome_of('text')} AS outcome
        FROM decisions) SELECT url, {r6('s * r * g')} AS authority_score,
        {r6('r')} AS recency_factor, {r6('g')} AS grounding_factor,
        {relevance_of('s')} AS relevance_label, {recency_label_of('y')} AS recency_label,
        {risk_of('y', 's')} AS authority_risk, outcome FROM a""",
    "strip_boilerplate": with_(*SECTIONS) + "SELECT url, md5(body) AS body_md5 FROM cleaned",
    "sections": with_(*SECTIONS) + "SELECT url, ord, name, priority, md5(text) AS text_md5"
    " FROM secs",
    "pack_text": with_(*SECTIONS, *[packed_of(f"p{b}", b) for b in (300, 1000, 8192, 32768)])
    + """SELECT url, md5(p300.packed) AS p300, md5(p1000.packed) AS p1000,
        md5(p8192.packed) AS p8192, md5(p32768.packed) AS p32768
        FROM p300 JOIN p1000 USING (url) JOIN p8192 USING (url) JOIN p32768 USING (url)""",
    "pack_text_strict": with_(*SECTIONS, packed_of("p", 1000, strict=True))
    + "SELECT url, md5(packed) AS p1000 FROM p",
    "truncate_analysis": with_(*SECTIONS) + "SELECT url, ord,"
    f" md5({cut_analysis('text', '(length(text) // 3)')}) AS cut_md5 FROM secs",
    "paragraph_markers": _EVERY_DECISION + "url, array_to_string("
    f"regexp_extract_all(text, {MARK}), '') AS markers FROM decisions",
    "heading_frequency": with_(*SECTIONS) + "SELECT name, count(*) AS sections"
    " FROM secs GROUP BY name",
    "unique_headings": with_(*SECTIONS) + "SELECT count(DISTINCT name) AS headings FROM secs",
    "section_profile": with_(*SECTIONS) + """SELECT url, row_number() OVER (PARTITION BY url
        ORDER BY priority, ord) - 1 AS place, name, priority, ord, length(text) AS length
        FROM secs""",
    "marker_coverage": f"""WITH {DECISIONS}, m AS (SELECT count(*) AS n,
        count(*) FILTER (contains(text, 'Decision Content')) AS content_marker,
        count(*) FILTER (contains(text, 'On this page')) AS contents_line,
        count(*) FILTER (contains(text, {q(fixed.FOOTNOTE_START)})) AS footnotes FROM decisions)
        SELECT marker, docs, {r6('docs * 100.0::DOUBLE / n')} AS percent FROM (
        SELECT n, unnest(['content_marker', 'contents_line', 'footnotes']) AS marker,
        unnest([content_marker, contents_line, footnotes]) AS docs FROM m)""",
    "corpus_profile": _EVERY_DECISION + """count(*) AS n_rows, min(document_date) AS min_date,
        max(document_date) AS max_date, round(avg(length(text)), 4) AS mean_text_length
        FROM decisions""",
    "quality_report": f"""WITH {DECISIONS}, {VECTORS} SELECT unnest(['bad_vector_values',
        'bad_vector_rows', 'truncated_texts', 'unmatched_urls', 'duplicate_urls',
        'non_finite_scores']) AS metric, unnest([
        (SELECT coalesce(sum(len(list_filter(embedding, lambda x: NOT isfinite(x)))), 0)
          FROM vectors)::BIGINT,
        (SELECT count(*) FROM vectors
          WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0),
        (SELECT count(*) FROM decisions WHERE length(text) > 32768),
        (SELECT count(*) FROM decisions WHERE url NOT IN (SELECT url FROM vectors)),
        (SELECT count(*) - count(DISTINCT url) FROM vectors), 0]) AS value""",
    "detect_terms": f"""WITH {DECISIONS}, {TERMS} SELECT d.url,
        coalesce(string_agg(term, '|' ORDER BY ord), '') AS terms
        FROM decisions d LEFT JOIN terms t USING (url) GROUP BY d.url""",
    "document_terms": f"""WITH {DECISIONS}, {TERMS}, {GLOSSARY} SELECT url, ord, term,
        definition, context FROM terms JOIN glossary USING (term)""",
    "term_frequency": f"WITH {DECISIONS}, {TERMS} SELECT term, count(*) AS docs FROM terms"
    " GROUP BY term",
    "get_entry": f"""WITH {DECISIONS}, {TERMS}, {GLOSSARY} SELECT url, upper(term) AS term,
        term AS entry, definition, context FROM terms JOIN glossary USING (term)""",
    "sanitize_card": with_(*SECTIONS, cards(False)) + "SELECT url, md5(card) AS card_md5"
    " FROM card",
    "card_sections": with_(*SECTIONS, cards(False)) + f"""SELECT url,
        max(md5({strip('bullets')})) FILTER (n = 0) AS issue,
        max(md5({strip('bullets')})) FILTER (n = 1) AS key_facts,
        max(md5({strip('bullets')})) FILTER (n = 2) AS test_applied,
        max(md5({strip('bullets')})) FILTER (n = 3) AS outcome FROM parts GROUP BY url""",
    "claim_sources": with_(*SECTIONS, _CLAIM_ROWS) + f"""SELECT url, section, ord,
        md5(text) AS claim_md5, CASE WHEN len(marks) > 0 THEN 'para ' || marks[1] || '-'
        || marks[-1] ELSE 'general context' END AS source_ref,
        CASE WHEN len(marks) > 0 THEN 'explicit' ELSE 'inferred' END AS confidence
        FROM claims""",
    "claim_confidence": with_(*SECTIONS, _CLAIM_ROWS) + """SELECT section,
        CASE WHEN len(marks) > 0 THEN 'explicit' ELSE 'inferred' END AS confidence,
        count(*) AS claims FROM claims GROUP BY ALL""",
    "generate_cards": with_(*SECTIONS, cards(False)) + "SELECT url AS key, url,"
    " md5(card) AS card_md5 FROM card",
    "align": f"""WITH {DECISIONS}, {VECTORS} SELECT d.pos, d.url,
        round({norm_of(normalized('embedding'))}, 4) AS norm
        FROM decisions d JOIN vectors v ON v.url = d.url""",
    "missing_vectors": f"WITH {DECISIONS}, {VECTORS} SELECT pos, url FROM decisions"
    " WHERE url NOT IN (SELECT url FROM vectors)",
    "new_decisions": f"""WITH {DECISIONS}, {VECTORS}, d AS (SELECT pos,
        CASE WHEN pos % 7 <> 0 THEN url END AS url FROM decisions)
        SELECT pos, url FROM d WHERE url IS NULL OR url NOT IN (SELECT url FROM vectors)""",
    "membership_set": f"WITH {VECTORS} SELECT DISTINCT url FROM vectors",
    "dedupe_keep_first": """SELECT min(doc_id) AS pos, CASE WHEN length(text) < 2000
        THEN 'short' ELSE md5(text) END AS url FROM documents GROUP BY 2""",
    "duplicate_counts": """SELECT count(*) AS total, count(DISTINCT text) AS distinct_keys,
        count(*) - count(DISTINCT text) AS duplicates FROM documents""",
    "merge_store": with_(VECTORS, DOC_VECTORS) + f"""SELECT pos, url,
        round({norm_of('v')}, 4) AS norm FROM (
        SELECT pos, url, embedding AS v FROM vectors UNION ALL SELECT pos + 1000000, url, v
        FROM doc_vec WHERE url NOT IN (SELECT url FROM vectors))""",
    "assign_chunks": f"WITH {DECISIONS}, {_CHUNKED} SELECT pos, idx, chunk_id FROM chunked",
    "assign_batches": with_(DECISIONS, _CHUNKED, """batched AS (
        SELECT chunk_id, idx, tokens, 0::BIGINT AS batch_id, 1 AS items, tokens AS used
          FROM chunked WHERE idx % 500 = 0
        UNION ALL
        SELECT c.chunk_id, c.idx, c.tokens,
          CASE WHEN b.items < 64 AND b.used + c.tokens <= 65536 THEN b.batch_id
            ELSE b.batch_id + 1 END,
          CASE WHEN b.items < 64 AND b.used + c.tokens <= 65536 THEN b.items + 1 ELSE 1 END,
          CASE WHEN b.items < 64 AND b.used + c.tokens <= 65536 THEN b.used + c.tokens
            ELSE c.tokens END
        FROM batched b JOIN chunked c ON c.chunk_id = b.chunk_id AND c.idx = b.idx + 1)""")
    + "SELECT chunk_id, idx, tokens, batch_id FROM batched",
    "pending_chunks": f"WITH {DECISIONS}, {VECTORS}, {_CHUNKED} SELECT url, chunk_id FROM chunked"
    " WHERE url NOT IN (SELECT url FROM vectors)",
    "plan_route": """SELECT conv_id, n, CASE WHEN n = 0 THEN 'none' WHEN n < 1000 THEN 'single'
        ELSE 'chunked' END AS route FROM (
        SELECT conv_id, sum(length(text))::BIGINT AS n FROM conversations GROUP BY conv_id)""",
    "search_statuses": with_(*search_ctes(FAST), """n_hit AS (
        SELECT query_id, count(*) AS n_hits FROM hits GROUP BY query_id)""") + f"""
        SELECT 'all' AS run, query_id, 'ok' AS status, n_hits, outcome_diversity,
          n >= 2 AS landscape_mode FROM (
          SELECT query_id, count(*) AS n, {_DIVERSE} AS outcome_diversity
          FROM assessed GROUP BY query_id) JOIN n_hit USING (query_id)
        UNION ALL SELECT 'no_vectors', query_id, 'no_candidates', 0, true, false FROM asked_text
        UNION ALL SELECT 'no_texts', query_id, 'none_after_rerank', n_hits, true, false
          FROM n_hit""",
    "top_cards": with_(*search_ctes(FAST), landscape_of("assessed"), cards(False), _BEST)
    + "SELECT query_id, url AS key, url, md5(card) AS card_md5 FROM best JOIN card USING (url)",
    "top_cards_grounded": with_(*search_ctes(FAST), landscape_of("assessed"), _BEST)
    + f"""SELECT query_id, url AS key, url, md5({q('**Issue:**' + chr(10) + '- ')}
        || {_card_prompt(fixed.GROUNDED_CARD_PROMPT, 2147483647)}) AS card_md5 FROM best""",
    "cards_without_url": with_(*SECTIONS, cards(False)) + f"""SELECT coalesce(nullif(
        {_result_url}, ''), 'rank-1:Unnamed:' || coalesce(document_date, '')) AS key,
        {_result_url} AS url, md5(card) AS card_md5 FROM card JOIN decisions USING (url)""",
    "write_vectors": f"WITH {DOC_VECTORS} SELECT url, pos, {digest('v')} FROM doc_vec",
    "delta_index": f"WITH {_DELTA} SELECT url, pos, {digest('v')} FROM store",
    "delta_stream": f"WITH {_DELTA} SELECT url, {digest('v')}, 2::BIGINT AS files_set_aside"
    " FROM store",
    "delta_token_limit": f"""WITH {DECISIONS}, w AS (SELECT url, text,
        len(regexp_extract_all(text, '[^ ]+')) AS n,
        regexp_extract(text, '^( *[^ ]+){{50}}') AS head FROM decisions)
        SELECT url, least(n, 50) AS words, length(CASE WHEN n > 50 THEN head ELSE text END) AS chars,
          50::BIGINT AS most, (SELECT count(*) FROM w WHERE n > 50) AS texts_cut FROM w""",
    "compact_store": f"""WITH {VECTORS} SELECT url,
        pos + CASE pos % 3 WHEN 0 THEN 2000000 WHEN 1 THEN 1000000 ELSE 0 END AS pos,
        round({norm_of('embedding')}, 4) AS norm,
        (SELECT count(*) FROM vectors) AS total, 1::BIGINT AS segments FROM vectors""",
    "encode_documents": f"WITH {DOC_VECTORS} SELECT url, {digest('v')} FROM doc_vec",
    "score_pairs": f"""SELECT t.conv_id, t.turn, {r6('''length(p.text)::DOUBLE
        / (length(p.text) + length(t.text))''')} AS score FROM conversations t
        JOIN conversations p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1""",
}
ORACLES["cosine_topk_grid"] = ORACLES["cosine_topk"]
for _same in ("delta_index_chunked", "delta_resume", "delta_reindex", "delta_other_encoder"):
    ORACLES[_same] = ORACLES["delta_index"]
for _same in ("search_seeded", "search_bucketed"):
    ORACLES[_same] = ORACLES["search_fast"]
ORACLES["build_index"] = ORACLES["align"]
ORACLES["merge_tables"] = ORACLES["merge_store"]
ORACLES["merge_store"] = f"""SELECT *, (SELECT count(*) FROM m) AS total,
    (SELECT count(*) FROM m WHERE pos >= 1000000) AS added FROM m""".join(
    ["WITH m AS (" + ORACLES["merge_tables"] + ") ", ""])

# Columns that are 32-bit integers in Spark.
_INTEGERS = {
    "candidate_projection": ["n"], "estimate_tokens": ["tokens"], "cosine_topk": ["stage1_rank"],
    "cosine_topk_grid": ["stage1_rank"], "hit_lookup": ["stage1_rank", "n"],
    "search_normal": ["rank"], "search_fast": ["rank"], "search_summary": ["n_hits"],
    "search_seeded": ["rank"], "search_bucketed": ["rank"], "search_statuses": ["n_hits"],
    "rerank_topk": ["stage2_rank"], "authority_rerank": ["authority_rank"],
    "landscape": ["rank"], "grounding": ["citations"], "section_profile": ["place", "length"],
    "document_terms": ["ord"], "claim_sources": ["ord"]}
for _name, _columns in _INTEGERS.items():
    _casts = ", ".join(f"{c}::INTEGER AS {c}" for c in _columns)
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
