"""Queries over the driver's tables, one or more for each operator, and the SQL that each equals.

Notes, spans, concepts and codes are derived from the tables by the helpers below, over all rows and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assertions as A
from ..operators import diagnostics, document, kb, lattice, lexicon, linking, models, proposals, resolver, retrieval, validation
from . import pipeline

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


def joined(x):
    return F.array_join(x, "|")


# ---------------------------------------------------------------- SQL pieces

W, SP = T.WORD, T.SPACE
lit = lambda s: "'" + s.replace("'", "''") + "'"
sfold = lambda x: f"replace(lower(coalesce({x}, '')), 'ß', 'ss')"
sdrop = lambda x: f"translate({x}, '{T.ACCENTED}', '{T.PLAIN}')"
ssqueeze = lambda x: f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"
snorm = lambda x, strip=False: ssqueeze(sdrop(sfold(x)) if strip else sfold(x))
swords = lambda x: f"regexp_extract_all({x}, '{W}')"
stokens = lambda x, strip=True: swords(snorm(x, strip))
spad = lambda x, strip=True: f"('  ' || {snorm(x, strip)} || '  ')"
sgrams = lambda v: f"list_sort(list_distinct(list_transform(range(1, length({v}) - 1), lambda i: substr({v}, i, 3))))"
smarked = lambda x: f"list_filter({x}, lambda t: regexp_matches(t, '[{T.ACCENTED}]'))"
sjoin = lambda x: f"coalesce(array_to_string({x}, '|'), '')"

TOK = f"""tok AS MATERIALIZED (
  SELECT doc_id, pos, w AS text, s AS "start", s + length(w) AS "end", {sfold('w')} AS folded FROM (
    SELECT doc_id, pos, w, CAST(sum(length(g)) OVER (PARTITION BY doc_id ORDER BY pos) + coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g FROM (
      SELECT doc_id, {swords('text')} AS ws, regexp_split_to_array(text, '{W}') AS gs FROM docs))))"""
DOCS = "docs AS MATERIALIZED (SELECT doc_id, text FROM documents)"
LINE = """line AS MATERIALIZED (
  SELECT doc_id, k AS line_no, printf('L%03d', k) AS line_id, s AS "start", s + length(t) AS "end", t AS text FROM (
    SELECT doc_id, k, t, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs))))"""

# ---------------------------------------------------------------- texts


@query(f"SELECT doc_id, {snorm('text')} AS norm, {snorm('text', True)} AS norm_ascii FROM documents")
def normalize_text(spark, d):
    return docs_of(spark, d).select("doc_id", T.normalize_text("text").alias("norm"), T.normalize_text("text", True).alias("norm_ascii"))


@query(f"SELECT doc_id, {sjoin(stokens('text'))} AS tokens, len({stokens('text')}) AS n FROM documents")
def tokens(spark, d):
    t = T.tokens("text")
    return docs_of(spark, d).select("doc_id", joined(t).alias("tokens"), F.size(t).cast("long").alias("n"))


@query(f"SELECT item_id, {sjoin(sgrams('v'))} AS grams FROM (SELECT item_id, {spad('text')} AS v FROM benchmark)")
def char_ngrams(spark, d):
    return read(spark, d, "benchmark").select("item_id", joined(T.char_ngrams("text")).alias("grams"))


@query(f"SELECT doc_id, {sjoin(smarked(stokens('text', False)))} AS marked FROM documents")
def accent_marked_tokens(spark, d):
    return docs_of(spark, d).select("doc_id", joined(T.accent_marked(T.tokens("text", False))).alias("marked"))


@query(f"WITH v AS MATERIALIZED (SELECT doc_id, {spad('text', False)} AS v FROM documents) SELECT doc_id, {sjoin(smarked(sgrams('v')))} AS marked FROM v")
def accent_marked_ngrams(spark, d):
    return docs_of(spark, d).select("doc_id", joined(T.char_ngrams("text", strip_accents=False, marked=True)).alias("marked"))


@query(f'WITH {DOCS}, {TOK} SELECT doc_id, pos, text, "start", "end", folded FROM tok')
def token_offsets(spark, d):
    return document.tokens_at(docs_of(spark, d))


@query(f"SELECT p_partkey, array_to_string({swords(sfold('p_name'))}, ' ') AS form_key FROM part")
def form_key(spark, d):
    return read(spark, d, "part").select("p_partkey", T.form_key("p_name").alias("form_key"))


_TITLE = "CASE p_size % 7 WHEN 0 THEN '- ' || p_name WHEN 1 THEN p_name || ',' WHEN 2 THEN 'Includes: ' || p_name WHEN 3 THEN '(' || substr(p_type, 1, 4) || ')' WHEN 4 THEN '• Ghi chú ' || p_name WHEN 5 THEN p_name || ' (' ELSE '  ' || p_name || ' ' END"
_GLYPHS = r"trim(regexp_replace({x}, '^[\s\-+*†‡•·\[\]()]+', ''))"


@query(
    f"WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part), b AS (SELECT *, {_GLYPHS.format(x='title')} AS bare FROM t), n AS (SELECT *, "
    + " OR ".join(f"starts_with({sfold('bare')}, {lit(m)})" for m in T.NOTE_MARKERS)
    + " AS is_note FROM b) SELECT p_partkey, bare, is_note, trim(title) = '' OR is_note OR regexp_matches(trim(title), '[,:(\\-+/]$') OR length(bare) <= 6 AS damaged FROM n"
)
def damaged_titles(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.expr(_TITLE).alias("title"))
    return rows.select("p_partkey", T.strip_glyphs("title").alias("bare"), T.is_note("title").alias("is_note"), T.is_damaged_title("title").alias("damaged"))


_DOSE = "p_name || ' ' || CAST(p_size AS VARCHAR) || '.50 MG/ML x ' || CAST(p_partkey AS VARCHAR) || ' mcg, 0,' || CAST(p_size AS VARCHAR) || '0 %'"
_VALUE = "replace(v, ',', '.')"


@query(
    f"""WITH s AS (SELECT p_partkey, {_DOSE} AS t FROM part),
    x AS (SELECT p_partkey, unnest(regexp_extract_all(t, {lit(T.STRENGTH)}, 1)) AS v, unnest(regexp_extract_all(t, {lit(T.STRENGTH)}, 2)) AS u, unnest(regexp_extract_all(t, {lit(T.STRENGTH)})) AS r, unnest(range(len(regexp_extract_all(t, {lit(T.STRENGTH)})))) AS k FROM s),
    y AS (SELECT p_partkey, k, CASE WHEN CAST({_VALUE} AS DOUBLE) = floor(CAST({_VALUE} AS DOUBLE)) THEN CAST(CAST({_VALUE} AS BIGINT) AS VARCHAR) ELSE printf('%g', CAST({_VALUE} AS DOUBLE)) END || lower(u) AS key, trim(r) AS raw FROM x)
    SELECT p_partkey, string_agg(key, '|' ORDER BY k) AS keys, string_agg(raw, '|' ORDER BY k) AS raws FROM y GROUP BY p_partkey"""
)
def parse_strengths(spark, d):
    rows = read(spark, d, "part").select("p_partkey", T.strengths(F.expr(_DOSE.replace("AS VARCHAR", "AS STRING"))).alias("s"))
    return rows.select("p_partkey", joined(F.transform("s", lambda x: x["key"])).alias("keys"), joined(F.transform("s", lambda x: x["raw"])).alias("raws"))


_CODE = "chr(65 + CAST(p_partkey % 26 AS INT)) || lpad(CAST(p_size AS VARCHAR), 2, '0') || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.' || CAST(p_partkey % 10 AS VARCHAR) WHEN 2 THEN CAST(p_partkey % 100 AS VARCHAR) ELSE '-x' END"
_CODE_SPARK = _CODE.replace("VARCHAR", "STRING")


@query(f"SELECT p_partkey, code, kind, CASE WHEN kind = 'dotted' THEN code WHEN kind = 'dotless' THEN CASE WHEN length(code) > 3 THEN substr(code, 1, 3) || '.' || substr(code, 4) ELSE code END END AS dotted, CASE WHEN kind <> 'malformed' THEN replace(code, '.', '') END AS dotless FROM (SELECT p_partkey, code, CASE WHEN regexp_matches(code, '{T.DOTTED}') THEN 'dotted' WHEN regexp_matches(code, '{T.DOTLESS}') THEN 'dotless' ELSE 'malformed' END AS kind FROM (SELECT p_partkey, {_CODE} AS code FROM part))")
def icd_dotting(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.expr(_CODE_SPARK).alias("code"))
    return rows.select("p_partkey", "code", T.icd_class("code").alias("kind"), T.to_dotted("code").alias("dotted"), T.to_dotless("code").alias("dotless"))


@query("WITH h AS (SELECT lang, doc_id, sha256(text) AS h FROM documents) SELECT lang, count(*) AS n, sha256(string_agg(h || chr(0), '' ORDER BY doc_id)) AS digest FROM h GROUP BY lang")
def checksums(spark, d):
    rows = read(spark, d, "documents").select("lang", F.struct("doc_id", T.checksum("text").alias("h")).alias("x"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), T.checksum_list(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"])).alias("digest"))


# ---------------------------------------------------------------- structure


@query(f'WITH {DOCS}, {LINE} SELECT doc_id, line_no, line_id, "start", "end", text FROM line')
def lines(spark, d):
    return document.lines(docs_of(spark, d))


@query(f"WITH {DOCS}, {LINE} SELECT doc_id, coalesce(string_agg(line_id || '| ' || text, chr(10) ORDER BY line_no) FILTER (WHERE length(regexp_replace(text, '{SP}+', '', 'g')) > 0), '') AS rendered FROM line GROUP BY doc_id")
def render_lines(spark, d):
    return docs_of(spark, d).select("doc_id", document.render("text").alias("rendered"))


@query(f'WITH {DOCS}, {TOK}, {LINE} SELECT t.doc_id, t.pos, t."start", min(l.line_no) AS line_no FROM tok t JOIN line l ON t.doc_id = l.doc_id AND l."start" <= t."start" AND t."start" <= l."end" GROUP BY ALL')
def line_of_offset(spark, d):
    docs = docs_of(spark, d)
    return document.line_of(document.tokens_at(docs).select("doc_id", "pos", "start"), document.lines(docs)).select("doc_id", "pos", "start", "line_no")


_SEP = f"([.!?;]){SP}+|\\n+"
SENT = f"""sent AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS BIGINT) AS pos, t AS text, s AS "start", s + length(t) AS "end" FROM (
    SELECT doc_id, g || p AS t, CAST(coalesce(sum(length(g) + length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (
      SELECT doc_id, unnest(range(len(gs))) AS k, unnest(gs) AS g, unnest(list_append(xs, '')) AS x, unnest(list_append(list_transform(xs, lambda x: regexp_extract(x, '^[.!?;]')), '')) AS p FROM (
        SELECT doc_id, regexp_split_to_array(text, '[.!?;]{SP}+|\\n+') AS gs, regexp_extract_all(text, '[.!?;]{SP}+|\\n+') AS xs FROM docs))) WHERE length(t) > 0)"""


@query(f'WITH {DOCS}, {SENT} SELECT doc_id, pos, text, "start", "end" FROM sent')
def sentences(spark, d):
    return document.sentences(docs_of(spark, d))


_HEADS = ("Tiền sử", "Khám", "Tiền sử gia đình", "Xử trí")
_CUES = ("không ", "mẹ ", "đã từng ", "", "bệnh nhân ", "bà ", "chưa ghi nhận ")


def notes_of(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document under one of four headings, with one of seven cues before its text."""
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k % len(values) + 1)
    note = F.array_join(F.transform(F.split("text", "\n", -1), lambda t, k: F.concat(pick(_HEADS, k), F.lit(": "), pick(_CUES, k), t)), "\n")
    return docs_of(spark, d).select("doc_id", note.alias("text"))


_pick = lambda values, k: "[" + ", ".join(lit(v) for v in values) + f"][(({k}) - 1) % {len(values)} + 1]"
NOTES = f"docs AS MATERIALIZED (SELECT doc_id, string_agg({_pick(_HEADS, 'k')} || ': ' || {_pick(_CUES, 'k')} || t, chr(10) ORDER BY k) AS text FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) GROUP BY doc_id)"
SECT = f"""sect AS MATERIALIZED (
  SELECT h.doc_id, heading, s AS "start", coalesce(nx, length(d.text)) AS "end", regexp_matches({sfold('heading')}, '{"|".join(document.HISTORY_HEADINGS)}') AS is_history, regexp_matches({sfold('heading')}, '{"|".join(document.FAMILY_HEADINGS)}') AS is_family FROM (
    SELECT doc_id, trim(regexp_extract(text, '^\\s*([^:\\n]{{2,60}}):', 1)) AS heading, "start" AS s, lead("start") OVER (PARTITION BY doc_id ORDER BY "start") AS nx FROM line WHERE regexp_matches(text, '^\\s*([^:\\n]{{2,60}}):')) h JOIN docs d ON h.doc_id = d.doc_id)"""


@query(f'WITH {NOTES}, {LINE}, {SECT} SELECT doc_id, heading, "start", "end", is_history, is_family FROM sect')
def sections(spark, d):
    return document.sections(notes_of(spark, d))


def long_words(docs: DataFrame) -> DataFrame:
    """Entities: words of at least ten letters, with a type by their length."""
    kinds = F.array(*[F.lit(t) for t in proposals.TYPES])
    return document.words_at(docs, lambda x: F.length(x) >= 10).select("doc_id", "start", "end", "text", F.element_at(kinds, (F.length("text") % 5 + 1).cast("int")).alias("type"))


ENT = f"""ent AS MATERIALIZED (SELECT doc_id, "start", "end", text, [{", ".join(lit(t) for t in proposals.TYPES)}][length(text) % 5 + 1] AS type FROM tok WHERE length(text) >= 10)"""
_BRK = r"[,;.:\n()\[\]]"
CLAUSE = f"""clause AS MATERIALIZED (
  SELECT e.*, d.text AS src, e."start" - length(regexp_extract(substr(d.text, 1, e."start"), '[^,;.:\\n()\\[\\]]*$')) AS l, e."end" + length(regexp_extract(substr(d.text, e."end" + 1), '^[^,;.:\\n()\\[\\]]*')) AS r FROM ent e JOIN docs d ON e.doc_id = d.doc_id)"""


@query(f'WITH {NOTES}, {TOK}, {ENT}, {CLAUSE} SELECT doc_id, "start", "end", CAST(l AS BIGINT) AS clause_start, CAST(r AS BIGINT) AS clause_end FROM clause')
def clauses(spark, d):
    docs = notes_of(spark, d)
    return document.with_clause(long_words(docs), docs).select("doc_id", "start", "end", "clause_start", "clause_end")


def scue(x: str, cues: tuple[str, ...]) -> tuple[str, str]:
    """(cue, place): the text is padded so that word ends need no look-around."""
    alt = "|".join(c.replace(".", "\\.") for c in cues)
    left = f"regexp_extract({x}, '^(?s)(.*?)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{alt})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)"
    return alt, left


def smatch(x: str, cues: tuple[str, ...]) -> str:
    """Struct (cue, place) of the first cue of the folded text x; place -1 if none."""
    alt = "|".join(cues)
    body = f"(' ' || {sfold(x)} || ' ')"
    pattern = f"[^\\p{{L}}\\p{{N}}_]({alt})[^\\p{{L}}\\p{{N}}_]"
    head = f"string_split_regex({body}, '{pattern}')[1]"
    return f"{{'cue': regexp_extract({body}, '{pattern}', 1), 'at': CASE WHEN regexp_matches({body}, '{pattern}') THEN length({head}) ELSE -1 END}}"


@query(f"WITH {NOTES}, {LINE}, c AS (SELECT doc_id, line_no, {smatch('text', A.NEGATION)} AS n, {smatch('text', A.FAMILY)} AS f FROM line) SELECT doc_id, line_no, n.cue AS negation, CAST(n.at AS BIGINT) AS negation_at, f.cue AS family, CAST(f.at AS BIGINT) AS family_at FROM c")
def first_cue(spark, d):
    n, at = document.first_cue(F.col("text"), A.NEGATION)
    f, fat = document.first_cue(F.col("text"), A.FAMILY)
    return document.lines(notes_of(spark, d)).select("doc_id", "line_no", n.alias("negation"), at.alias("negation_at"), f.alias("family"), fat.alias("family_at"))


@query(
    f"""WITH {NOTES}, {LINE}, {TOK}, {ENT}, {SECT}, {SENT}, {CLAUSE},
    near AS (SELECT doc_id, "start", "end", trim(text) AS cur, coalesce(trim(lag(text) OVER w), '') AS prev, coalesce(trim(lead(text) OVER w), '') AS nxt FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY "start"))
    SELECT e.doc_id, e."start", e."end", coalesce(n.prev, '') AS previous_sentence, coalesce(n.cur, '') AS current_sentence, coalesce(n.nxt, '') AS next_sentence, coalesce(s.heading, '') AS heading
    FROM ent e LEFT JOIN near n ON e.doc_id = n.doc_id AND e."start" >= n."start" AND e."start" < n."end" LEFT JOIN sect s ON e.doc_id = s.doc_id AND e."start" >= s."start" AND e."start" < s."end" """
)
def mention_context(spark, d):
    docs = notes_of(spark, d)
    rows = document.mention_context(long_words(docs), docs)
    return rows.select("doc_id", "start", "end", "previous_sentence", "current_sentence", "next_sentence", "heading")


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, length(n)) = n), lambda i: CAST(i - 1 AS VARCHAR)), '|') AS at FROM (SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN 'e' ELSE 'l' END AS n FROM part)")
def occurrences(spark, d):
    needle = F.when(F.col("p_size") % 2 == 0, "e").otherwise("l")
    return read(spark, d, "part").select("p_partkey", joined(F.transform(document.occurrences(F.col("p_name"), needle), lambda i: i.cast("string"))).alias("at"))


_NOT_TYPE = f"(SELECT doc_id, \"start\", is_history, is_family FROM sect)"
@query(
    f"""WITH {NOTES}, {LINE}, {TOK}, {ENT}, {SECT}, {CLAUSE},
    x AS (SELECT c.*, coalesce(s.is_history, false) AS ih, coalesce(s.is_family, false) AS fam, substr(src, l + 1, c."start" - l) AS before, substr(src, l + 1, r - l) AS cl FROM clause c LEFT JOIN sect s ON c.doc_id = s.doc_id AND c."start" >= s."start" AND c."start" < s."end"),
    y AS (SELECT *, {smatch('before', A.NEGATION)} AS neg, {smatch('cl', A.PATIENT)} AS me, {smatch('cl', A.FAMILY)} AS k1, {smatch('cl', A.FAMILY_OR_ADDRESS)} AS k2, {smatch('cl', A.PAST)} AS past FROM x),
    z AS (SELECT *, CASE WHEN k1.cue = '' AND fam THEN k2 ELSE k1 END AS kin, type IN ('THUỐC', 'CHẨN_ĐOÁN', 'TRIỆU_CHỨNG') AS ok FROM y)
    SELECT doc_id, "start", "end", type, ok AND neg.cue <> '' AND (neg.cue NOT IN ('hết', 'ko', 'k có') OR "start" - l <= 40) AS negated,
      ok AND NOT (kin.cue <> '' AND contains({sfold('text')}, kin.cue)) AND NOT (me.at >= 0 AND (kin.at < 0 OR me.at < kin.at)) AND ((kin.cue <> '' AND kin.at >= 0 AND l + kin.at < "start") OR fam) AS family,
      ok AND (ih OR past.cue <> '') AS historical FROM z"""
)
def assertions(spark, d):
    docs = notes_of(spark, d)
    return A.assertions(long_words(docs), docs).select("doc_id", "start", "end", "type", "negated", "family", "historical")


@query(f"WITH a AS ({SQL['assertions']}) SELECT assertion, count(*) AS n FROM (SELECT 'isNegated' AS assertion FROM a WHERE negated UNION ALL SELECT 'isFamily' FROM a WHERE family UNION ALL SELECT 'isHistorical' FROM a WHERE historical) GROUP BY assertion")
def assertion_counts(spark, d):
    docs = notes_of(spark, d)
    return A.assertion_counts(A.assertions(long_words(docs), docs))


# ---------------------------------------------------------------- lexicon


def concepts_of(spark: SparkSession, d: str) -> DataFrame:
    """Concepts named by the first three words of each benchmark text, with two aliases further on."""
    w = T.words("text")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    rows = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("concept_id"), part(1, 3).alias("canonical_name"), F.array(part(4, 5), part(9, 4)).alias("aliases"))
    return rows.withColumn("entity_type", F.lit("CHẨN_ĐOÁN")).withColumn("ontology", F.lit("ICD10")).withColumn("metadata", F.create_map(F.lit("name_quality"), F.lit("clean")))


CONC = f"""conc AS (SELECT CAST(item_id AS VARCHAR) AS concept_id, array_to_string(w[1:3], ' ') AS canonical_name, [array_to_string(w[4:8], ' '), array_to_string(w[9:12], ' ')] AS aliases FROM (SELECT item_id, {swords('text')} AS w FROM benchmark)),
form AS MATERIALIZED (SELECT concept_id, unnest(range(3)) AS seq, unnest(list_concat([canonical_name], aliases)) AS form FROM conc)"""


def part_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts from part: many share a name, so the gates of the lexicon have work."""
    quality = F.when(F.col("p_size") == 13, "suspect").otherwise("clean")
    rows = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("concept_id"), F.col("p_name").alias("canonical_name"), F.array(F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")), F.element_at(F.split("p_type", " "), 1)).alias("aliases"), quality.alias("q"))
    return rows.select("concept_id", "canonical_name", "aliases", F.lit("THUỐC").alias("entity_type"), F.create_map(F.lit("name_quality"), F.col("q")).alias("metadata"))


PCON = f"""pcon AS (SELECT CAST(p_partkey AS VARCHAR) AS concept_id, p_name, p_size = 13 AS suspect, [p_name, p_name || ' ' || p_brand || ' ' || CAST(p_partkey AS VARCHAR), string_split(p_type, ' ')[1]] AS forms FROM part),
pform AS MATERIALIZED (SELECT concept_id, suspect, unnest(range(3)) AS seq, trim(unnest(forms)) AS form FROM pcon),
pkey AS MATERIALIZED (SELECT *, array_to_string({swords(sfold('form'))}, ' ') AS form_key, len({swords('form')}) AS n_tokens FROM pform WHERE form <> ''),
amb AS (SELECT form_key, count(DISTINCT concept_id) AS named FROM pkey WHERE form_key <> '' GROUP BY form_key),
share AS (SELECT token, count(*) / (SELECT count(DISTINCT concept_id) FROM pkey) AS share FROM (SELECT DISTINCT concept_id, unnest({swords(sfold('form'))}) AS token FROM pkey) GROUP BY token)"""


@query(f"WITH {PCON} SELECT form_key, named AS concepts_named FROM amb")
def form_ambiguity(spark, d):
    return lexicon.form_ambiguity(lexicon.surface_forms(part_concepts(spark, d)))


@query(f"WITH {PCON} SELECT token, CAST(share AS DOUBLE) AS share FROM share")
def token_label_share(spark, d):
    return lexicon.token_label_share(lexicon.surface_forms(part_concepts(spark, d)))


@query(
    f"""WITH {PCON} SELECT concept_id, seq, form, CASE WHEN suspect THEN 'suspect_label' WHEN n_tokens > 8 THEN 'too_many_tokens' WHEN coalesce(a.named, 1) > 3 THEN 'ambiguous_form'
    WHEN n_tokens = 1 AND coalesce(s.share, 0) > 0.01 THEN 'common_token' WHEN n_tokens = 0 THEN 'no_tokens' WHEN n_tokens = 1 AND length(k.form_key) < 3 THEN 'single_token_too_short' END AS reason
    FROM pkey k LEFT JOIN amb a ON k.form_key = a.form_key LEFT JOIN share s ON k.form_key = s.token"""
)
def lexicon_gates(spark, d):
    return lexicon.build_lexicon(part_concepts(spark, d)).select("concept_id", F.col("seq").cast("long").alias("seq"), "form", "reason")


ALIAS_SQL = f"""{TOK}, {CONC},
  entry AS (SELECT k AS form_key, len(string_split(k, ' ')) AS n, arg_min(form, struct_pack(c := concept_id, s := seq)) AS phrase, count(DISTINCT concept_id) AS named FROM (SELECT concept_id, seq, form, array_to_string({swords(sfold('form'))}, ' ') AS k FROM form WHERE form <> '') GROUP BY k),
  grams AS (SELECT doc_id, pos, "start", {", ".join(f'lead(folded, {k}) OVER w AS f{k}, lead("end", {k}) OVER w AS e{k}' for k in range(8))} FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  runs AS ({" UNION ALL ".join(f'SELECT doc_id, pos, "start", e{k} AS "end", {k + 1} AS n, concat_ws(chr(32), {", ".join(f"f{j}" for j in range(k + 1))}) AS form_key FROM grams WHERE e{k} IS NOT NULL' for k in range(8))}),
  best AS MATERIALIZED (SELECT * FROM (SELECT r.*, e.phrase, e.named, row_number() OVER (PARTITION BY r.doc_id, r.pos ORDER BY r.n DESC) AS rn FROM runs r JOIN entry e ON r.form_key = e.form_key AND r.n = e.n) WHERE rn = 1),
  numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM best)"""


@query(
    f"""WITH RECURSIVE {DOCS}, {ALIAS_SQL},
    walk AS (SELECT doc_id, i, pos + n AS free, true AS taken FROM numbered WHERE i = 1 UNION ALL SELECT b.doc_id, b.i, CASE WHEN b.pos >= w.free THEN b.pos + b.n ELSE w.free END, b.pos >= w.free FROM walk w JOIN numbered b ON b.doc_id = w.doc_id AND b.i = w.i + 1)
    SELECT b.doc_id, b."start", b."end", substr(d.text, b."start" + 1, b."end" - b."start") AS text, b.phrase, 'CHẨN_ĐOÁN' AS entity_type, b.named AS concepts_named FROM numbered b JOIN walk w ON b.doc_id = w.doc_id AND b.i = w.i AND w.taken JOIN docs d ON d.doc_id = b.doc_id"""
)
def alias_hits(spark, d):
    return lexicon.alias_hits(docs_of(spark, d), lexicon.build_lexicon(concepts_of(spark, d), max_concepts=1000, max_share=1.0))


# ---------------------------------------------------------------- proposals, lattice, resolution


def spans_of(docs: DataFrame) -> DataFrame:
    """Spans that begin at a word of nine letters or more and run on for up to three words, with type and sources by length."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    n = F.length("text")
    t = document.tokens_at(docs)
    ahead = F.element_at(F.array(*[F.lead("end", k).over(order) for k in range(4)]), (n % 4 + 1).cast("int"))
    t = t.withColumn("e", F.coalesce(ahead, "end")).where(n >= 9)
    kinds = F.array(*[F.lit(x) for x in proposals.TYPES])
    sources = F.element_at(F.array(*[F.array(*[F.lit(s) for s in x]) for x in _SOURCES]), (n % 4 + 1).cast("int"))
    rows = t.select("doc_id", "start", F.col("e").alias("end"), F.element_at(kinds, (n % 5 + 1).cast("int")).alias("type"), sources.alias("sources"), "pos")
    return rows.join(docs.select("doc_id", F.col("text").alias("src")), "doc_id").select("doc_id", "start", "end", "type", document.slice_of("src", "start", "end").alias("text"), "sources", F.col("pos").alias("seq"))


_SOURCES = (("e3",), ("qwen_context",), ("e3", "qwen_context"), ("governed_alias",))
SPAN = f"""span AS MATERIALIZED (SELECT t.doc_id, t."start", t.e AS "end", [{", ".join(lit(x) for x in proposals.TYPES)}][length(t.text) % 5 + 1] AS type, substr(d.text, t."start" + 1, t.e - t."start") AS text, [{", ".join("[" + ", ".join(lit(s) for s in x) + "]" for x in _SOURCES)}][length(t.text) % 4 + 1] AS sources, pos AS seq
  FROM (SELECT *, coalesce([lead("end", 0) OVER w, lead("end", 1) OVER w, lead("end", 2) OVER w, lead("end", 3) OVER w][length(text) % 4 + 1], "end") AS e FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) t JOIN docs d ON t.doc_id = d.doc_id WHERE length(t.text) >= 9)"""
GROUP = """grp AS MATERIALIZED (SELECT *, CAST(sum(nw) OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, type ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS group_id FROM (
  SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM span))"""


def asked_rows(docs: DataFrame) -> DataFrame:
    """Rows as a model gives them: each word of its line, an occurrence by its length, some with a wrong line."""
    t = document.line_of(document.tokens_at(docs).where(F.length("text") >= 10), document.lines(docs))
    n = F.length("text")
    line = F.when(n % 5 == 0, "L999").when(n % 7 == 0, "").otherwise(F.col("line_id"))
    return t.select("doc_id", F.col("pos").alias("seq"), line.alias("line_id"), "text", (n % 2).cast("long").alias("occurrence"))


_OCC = lambda h, n: f"list_filter(range(1, length({h}) - length({n}) + 2), lambda i: substr({h}, i, length({n})) = {n})"


@query(
    f"""WITH {DOCS}, {TOK}, {LINE},
    own AS MATERIALIZED (SELECT t.doc_id, t.pos, min(l.line_id) AS line_id FROM tok t JOIN line l ON l.doc_id = t.doc_id AND l."start" <= t."start" AND t."start" <= l."end" WHERE length(t.text) >= 10 GROUP BY t.doc_id, t.pos),
    a AS MATERIALIZED (SELECT t.doc_id, t.pos AS seq, CASE WHEN length(t.text) % 5 = 0 THEN 'L999' WHEN length(t.text) % 7 = 0 THEN '' ELSE o.line_id END AS line_id, t.text, CAST(length(t.text) % 2 AS BIGINT) AS occ FROM tok t JOIN own o ON t.doc_id = o.doc_id AND t.pos = o.pos),
    b AS MATERIALIZED (SELECT a.*, l."start" AS ls, l.text AS lt, d.text AS src, coalesce({_OCC('l.text', 'a.text')}, []) AS inl FROM a LEFT JOIN line l ON a.doc_id = l.doc_id AND a.line_id = l.line_id JOIN docs d ON d.doc_id = a.doc_id),
    c AS (SELECT *, CASE WHEN len(inl) = 0 THEN (length(src) - length(replace(src, text, ''))) // length(text) ELSE 0 END AS nd FROM b),
    e AS (SELECT *, CASE WHEN len(inl) > 0 AND occ >= len(inl) THEN 'occurrence_out_of_range' WHEN len(inl) = 0 AND nd = 0 THEN CASE WHEN lt IS NULL THEN 'unknown_line_id' ELSE 'text_not_in_source' END WHEN len(inl) = 0 AND nd > 1 THEN 'ambiguous_without_line' END AS reason FROM c),
    f AS (SELECT *, CASE WHEN reason IS NOT NULL THEN -1 WHEN len(inl) > 0 THEN ls + inl[occ + 1] - 1 ELSE instr(src, text) - 1 END AS s FROM e)
    SELECT doc_id, seq, text, CAST(s AS BIGINT) AS "start", CAST(CASE WHEN reason IS NULL THEN s + length(text) ELSE -1 END AS BIGINT) AS "end", CASE WHEN reason IS NOT NULL THEN '' WHEN len(inl) > 0 THEN 'line' ELSE 'unique' END AS how, reason FROM f"""
)
def align(spark, d):
    docs = docs_of(spark, d)
    return proposals.align(docs, asked_rows(docs)).select("doc_id", "seq", "text", "start", "end", "how", "reason")


def pooled_of(docs: DataFrame) -> DataFrame:
    """Spans of two sources pooled: each span, and once more those of even length as a phrase hit."""
    rows = spans_of(docs).withColumn("line_id", F.lit("")).withColumn("how", F.lit("offsets"))
    again = rows.where((F.col("end") - F.col("start")) % 2 == 0).withColumn("sources", F.array(F.lit("governed_alias"))).withColumn("seq", F.col("seq") + 100000)
    return proposals.pool(rows.unionByName(again))


POOL = f"""twice AS (SELECT doc_id, "start", "end", type, text, sources FROM span UNION ALL SELECT doc_id, "start", "end", type, text, ['governed_alias'] FROM span WHERE ("end" - "start") % 2 = 0),
pool AS MATERIALIZED (SELECT doc_id, "start", "end", type, min(text) AS text, list_sort(list_distinct(flatten(list(sources)))) AS sources FROM twice GROUP BY ALL)"""
POOL = POOL.replace("GROUP BY ALL", 'GROUP BY doc_id, "start", "end", type')


@query(f'WITH {DOCS}, {TOK}, {SPAN}, {POOL} SELECT doc_id, "start", "end", type, text, array_to_string(sources, \'|\') AS sources FROM pool')
def pool_merge(spark, d):
    return pooled_of(docs_of(spark, d)).select("doc_id", "start", "end", "type", "text", joined("sources").alias("sources"))


@query(f"""WITH {DOCS}, {TOK}, {SPAN}, {POOL} SELECT p.doc_id, p."start", p."end", p.type, NOT list_contains(p.sources, 'e3') AND EXISTS (SELECT 1 FROM pool q WHERE q.doc_id = p.doc_id AND q.type = p.type AND list_contains(q.sources, 'e3') AND p."start" <= q."start" AND q."end" <= p."end" AND (p."start" <> q."start" OR p."end" <> q."end")) AS subsumes_seed FROM pool p""")
def seed_completion(spark, d):
    return proposals.mark_completions(pooled_of(docs_of(spark, d))).select("doc_id", "start", "end", "type", "subsumes_seed")


@query(f'WITH {DOCS}, {TOK}, {SPAN}, {GROUP} SELECT doc_id, "start", "end", type, group_id FROM grp')
def clusters(spark, d):
    return lattice.clusters(spans_of(docs_of(spark, d))).select("doc_id", "start", "end", "type", "group_id")


_PUNCT = lattice.PUNCTUATION.replace("'", "''")
_CONN = "(" + ", ".join(lit(c) for c in lattice.CONNECTORS) + ")"
_REASON = lambda g: f"""CASE WHEN regexp_matches({g}, '{_PUNCT}') THEN 'bridge_crosses_punctuation_or_newline' WHEN {ssqueeze(g)} = '' THEN 'fragments_overlap_or_touch' WHEN contains({ssqueeze(g)}, ' ') THEN 'bridge_longer_than_one_token' WHEN {ssqueeze(sfold(g))} IN {_CONN} THEN 'bridge_contains_connector' WHEN regexp_matches(regexp_extract({g}, '\\p{{L}}'), '^\\p{{Lu}}') THEN 'bridge_contains_unexpected_capitalised_word' ELSE 'bridge_is_a_single_ordinary_word' END"""


@query(f"""WITH {DOCS}, {TOK}, g AS (SELECT t.doc_id, pos, substr(d.text, "end" + 1, nx - "end") AS gap FROM (SELECT *, lead("start", CAST(length(text) % 3 + 1 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM tok) t JOIN docs d ON d.doc_id = t.doc_id WHERE nx IS NOT NULL) SELECT doc_id, pos, gap, {_REASON('gap')} AS reason FROM g""".replace('lead("start", CAST(length(text) % 3 + 1 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos)', '[lead("start", 1) OVER (PARTITION BY doc_id ORDER BY pos), lead("start", 2) OVER (PARTITION BY doc_id ORDER BY pos), lead("start", 3) OVER (PARTITION BY doc_id ORDER BY pos)][length(text) % 3 + 1]'))
def safe_bridge(spark, d):
    gaps = document.gaps_ahead(docs_of(spark, d), lambda word: F.length(word) % 3 + 1, 3)
    return gaps.select("doc_id", "pos", "gap", lattice.bridge_reason(F.col("gap")).alias("reason"))


@query(
    f"""WITH {DOCS}, {TOK}, {SPAN}, {GROUP},
    b AS (SELECT DISTINCT l.doc_id, l.group_id, l."start", r."end", l.type FROM grp l JOIN grp r ON l.doc_id = r.doc_id AND l.group_id = r.group_id AND l.type = r.type AND l."end" <= r."start" AND (l."start" < r."start" OR (l."start" = r."start" AND l."end" < r."end")) JOIN docs d ON d.doc_id = l.doc_id
      WHERE {_REASON('substr(d.text, l."end" + 1, r."start" - l."end")')} IN ('fragments_overlap_or_touch', 'bridge_is_a_single_ordinary_word')),
    o AS (SELECT doc_id, group_id, "start", "end", type FROM grp UNION ALL SELECT b.* FROM b ANTI JOIN grp g ON b.doc_id = g.doc_id AND b."start" = g."start" AND b."end" = g."end" AND b.type = g.type)
    SELECT doc_id, group_id, CAST(row_number() OVER (PARTITION BY doc_id, group_id ORDER BY "start", "end" DESC, type) - 1 AS BIGINT) AS option_idx, "start", "end", type FROM o"""
)
def lattice_options(spark, d):
    docs = docs_of(spark, d)
    return lattice.options(spans_of(docs), docs).select("doc_id", "group_id", "option_idx", "start", "end", "type")


@query(
    f"""WITH o AS ({SQL['lattice_options']}), s AS (SELECT doc_id, group_id, option_idx, ("end" - "start") % 4 AS m, "start", "end", type FROM o)
    SELECT doc_id, group_id, option_idx, m < 2 AS accepted, CASE WHEN m = 1 THEN 'THUỐC' ELSE type END AS type FROM s"""
)
def apply_verdicts(spark, d):
    docs = docs_of(spark, d)
    opts = lattice.options(spans_of(docs), docs)
    m = (F.col("end") - F.col("start")) % 4
    verdicts = opts.where(m < 3).select("doc_id", "group_id", F.col("option_idx").alias("index"), F.when(m == 0, "accept").when(m == 1, "retype").otherwise("reject").alias("action"), F.when(m == 1, "THUỐC").otherwise("").alias("type"))
    return lattice.apply_verdicts(opts, verdicts).select("doc_id", "group_id", "option_idx", "accepted", "type")


@query()
def resolve_overlaps(spark, d):
    return resolver.resolve_overlaps(spans_of(docs_of(spark, d)))


@query(
    f"""WITH {DOCS}, {TOK}, {LINE}, {SPAN}, r AS (SELECT s.*, (SELECT arg_min(l."start", l.line_no) FROM line l WHERE l.doc_id = s.doc_id AND l."start" <= s."start" AND s."start" <= l."end") AS ls FROM span s)
    SELECT doc_id, "start", "end", type FROM r WHERE type <> 'KẾT_QUẢ_XÉT_NGHIỆM' OR EXISTS (SELECT 1 FROM span n WHERE n.doc_id = r.doc_id AND n.type = 'TÊN_XÉT_NGHIỆM' AND n."end" <= r."start" AND r."start" - n."end" <= 160 AND (r.ls IS NULL OR n."start" >= r.ls))"""
)
def anchored_results(spark, d):
    docs = docs_of(spark, d)
    return resolver.anchored_results(spans_of(docs).drop("sources"), document.lines(docs)).select("doc_id", "start", "end", "type")


@query(
    f"""WITH c AS ({SQL['seed_completion']}), m AS ({SQL['pool_merge']}) SELECT m.doc_id, m."start", m."end", m.type, CASE WHEN contains(sources, 'e3') AND contains(sources, 'qwen_context') THEN 'e3_and_qwen_agree' WHEN contains(sources, 'qwen_context') AND contains(sources, 'governed_alias') THEN 'qwen_with_governed_alias_support'
    WHEN subsumes_seed AND contains(sources, 'qwen_context') THEN 'qwen_completed_an_e3_fragment' WHEN contains(sources, 'e3') THEN 'e3_baseline' ELSE 'single_unsupported_source' END AS reason FROM m JOIN c ON m.doc_id = c.doc_id AND m."start" = c."start" AND m."end" = c."end" AND m.type = c.type"""
)
def high_confidence(spark, d):
    rows = proposals.mark_completions(pooled_of(docs_of(spark, d)))
    return rows.select("doc_id", "start", "end", "type", resolver.confidence_reason(F.col("sources"), F.col("subsumes_seed")).alias("reason"))


# ---------------------------------------------------------------- knowledge base


def codes_of(spark: SparkSession, d: str) -> DataFrame:
    """Diagnosis concepts: a code of a letter, two digits and up to two more signs, with p_name as the title."""
    rows = read(spark, d, "part")
    return rows.select(F.expr(_KB_CODE).alias("concept_id"), F.struct("p_partkey", "p_name", "p_brand", "p_type").alias("p")).groupBy("concept_id").agg(F.min("p").alias("p")).select("concept_id", F.col("p.p_name").alias("canonical_name"), F.array("p.p_brand", "p.p_type").alias("aliases"))


_KB_CODE = "chr(65 + CAST(p_partkey % 3 AS INT)) || lpad(CAST(p_size % 10 AS STRING), 2, '0') || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(p_partkey % 10 AS STRING) ELSE CAST(p_partkey % 10 AS STRING) || CAST(p_size % 7 AS STRING) END"
KBC = f"kbc AS MATERIALIZED (SELECT code, x.p_name AS name, [x.p_brand, x.p_type] AS aliases FROM (SELECT {_KB_CODE.replace('STRING', 'VARCHAR')} AS code, min(struct_pack(p_partkey := p_partkey, p_name := p_name, p_brand := p_brand, p_type := p_type)) AS x FROM part GROUP BY 1))"


@query(f"WITH {KBC} SELECT a.code, a.name AS label, coalesce(p.code, '') AS parent_code, coalesce(p.name, '') AS parent_label, CASE WHEN length(a.code) > 3 THEN (SELECT count(*) FROM kbc s WHERE substr(s.code, 1, 3) = substr(a.code, 1, 3) AND s.code <> a.code AND length(s.code) = length(a.code)) ELSE 0 END AS sibling_count, (SELECT count(*) FROM kbc c WHERE starts_with(c.code, a.code) AND c.code <> a.code) AS child_count FROM kbc a LEFT JOIN kbc p ON p.code = substr(a.code, 1, 3) AND p.code <> a.code")
def icd_facts(spark, d):
    return kb.icd_facts(codes_of(spark, d)).select("code", "label", "parent_code", "parent_label", "sibling_count", "child_count")


@query(f"WITH {KBC} SELECT CAST(row_number() OVER (ORDER BY a.code) - 1 AS BIGINT) AS row_no, 'ICD10' AS ontology, a.code AS concept_id, a.name || ' | ' || array_to_string(a.aliases, '; ') || CASE WHEN p.code IS NOT NULL THEN ' | thuộc nhóm ' || p.name ELSE '' END AS text FROM kbc a LEFT JOIN kbc p ON p.code = substr(a.code, 1, 3) AND p.code <> a.code")
def kb_documents(spark, d):
    return kb.kb_documents(codes_of(spark, d))


def atoms_of(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of a drug snapshot: lines of an order as strings of a concept, each part of them as a source."""
    rows = read(spark, d, "lineitem")
    return rows.select(F.col("l_partkey").alias("rxcui"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("rxaui"), F.col("l_returnflag").alias("tty"), (F.col("l_linestatus") == "O").alias("is_pref"), F.when(F.col("l_returnflag") == "R", "O").otherwise("N").alias("suppress"), F.concat_ws(" ", "l_returnflag", F.col("l_orderkey").cast("string")).alias("string"))


ATOM = "atom AS (SELECT l_partkey AS rxcui, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS rxaui, l_returnflag AS tty, l_linestatus = 'O' AS is_pref, l_returnflag = 'R' AS sup, l_returnflag || ' ' || CAST(l_orderkey AS VARCHAR) AS string FROM lineitem)"


@query(f"WITH {ATOM} SELECT rxcui, rxaui, string FROM (SELECT *, row_number() OVER (PARTITION BY rxcui ORDER BY sup, NOT is_pref, tty, rxaui) AS k FROM atom) WHERE k = 1")
def preferred_atom(spark, d):
    return kb.preferred_atom(atoms_of(spark, d))


@query(f"WITH {ATOM} SELECT rxcui, bool_and(sup) AS suppressed FROM atom GROUP BY rxcui")
def suppressed(spark, d):
    return kb.suppressed_concepts(atoms_of(spark, d))


@query(f"WITH {ATOM} SELECT rxcui, string_agg(DISTINCT tty, '|' ORDER BY tty) AS ttys FROM atom GROUP BY rxcui")
def term_types(spark, d):
    return kb.term_types(atoms_of(spark, d)).select("rxcui", joined("ttys").alias("ttys"))


def relations_of(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (*kb.REMAP_RELATIONS, "isa", "has_ingredient")])
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("rxcui1"), F.col("l_partkey").alias("rxcui2"), F.element_at(names, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("rela"))


@query("SELECT l_suppkey AS rxcui1, string_agg(DISTINCT lpad(CAST(l_partkey AS VARCHAR), 9, '0'), '|' ORDER BY lpad(CAST(l_partkey AS VARCHAR), 9, '0')) AS targets FROM lineitem WHERE l_linenumber % 5 < 3 GROUP BY l_suppkey")
def remap(spark, d):
    rows = kb.remap_targets(relations_of(spark, d))
    return rows.select("rxcui1", joined(F.transform("targets", lambda t: F.lpad(t.cast("string"), 9, "0"))).alias("targets"))


# ---------------------------------------------------------------- retrieval


def questions_of(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every distinct part name."""
    return read(spark, d, "part").select(F.col("p_name").alias("query")).distinct().select(F.col("query").alias("query_id"), "query")


def names_of(spark: SparkSession, d: str) -> DataFrame:
    """Concepts: each distinct pair of part name and type."""
    rows = read(spark, d, "part").select("p_name", "p_type").distinct()
    return rows.select(F.lit("RXNORM").alias("ontology"), F.concat_ws("/", "p_name", "p_type").alias("concept_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("canonical_name"), F.array("p_name").alias("aliases"))


def _terms(x: str, tiered: bool) -> list[tuple[str, str]]:
    """(channel, list of terms) of the form x."""
    return [("exact_ascii", f"[{snorm(x, True)}]"), ("char_ngram", sgrams(spad(x))), ("sparse", stokens(x))]


def _retrieval_sql(tiered: bool) -> str:
    name = [*_terms("form", tiered), *([] if tiered else [("exact", f"[{snorm('form')}]")])]
    post = " UNION ".join(f"SELECT '{c}' AS channel, unnest({t}) AS term, concept_id FROM nform" for c, t in name)
    if tiered:
        post += f" UNION SELECT 'exact_canonical', {snorm('form')}, concept_id FROM nform WHERE k = 0 UNION SELECT 'exact_alias', {snorm('form')}, concept_id FROM nform WHERE k = 1"
    ask = [*_terms("q", tiered), *([("exact_canonical", f"[{snorm('q')}]"), ("exact_alias", f"[{snorm('q')}]")] if tiered else [("exact", f"[{snorm('q')}]")])]
    asks = " UNION ALL ".join(f"SELECT q AS query_id, '{c}' AS channel, unnest({t}) AS term FROM quest" for c, t in ask)
    points = "CASE WHEN p.channel LIKE 'exact%' THEN CASE WHEN p.channel = 'exact_ascii' THEN 80 ELSE 100 END WHEN p.channel = 'sparse' THEN 2 ELSE 1 END"
    tiers = "CASE p.channel WHEN 'exact_canonical' THEN 1 WHEN 'exact_alias' THEN 2 WHEN 'exact_ascii' THEN 5 ELSE 6 END"
    return f"""quest AS (SELECT DISTINCT p_name AS q FROM part), conc AS (SELECT DISTINCT p_name || '/' || p_type AS concept_id, p_name || ' ' || lower(p_type) AS name, p_name AS alias FROM part),
  nform AS MATERIALIZED (SELECT concept_id, unnest([0, 1]) AS k, unnest([name, alias]) AS form FROM conc), post AS MATERIALIZED ({post}), ask AS MATERIALIZED ({asks}),
  hit AS (SELECT a.query_id, p.concept_id, p.channel, sum({points}) AS pts, min({tiers}) AS tr FROM ask a JOIN post p ON a.channel = p.channel AND a.term = p.term GROUP BY ALL),
  ev AS MATERIALIZED (SELECT query_id, concept_id, CAST(sum(pts) AS BIGINT) AS score, string_agg(channel, '|' ORDER BY channel) AS channels, CAST({'min(tr)' if tiered else '7'} AS BIGINT) AS tier, CAST(max(CASE WHEN channel LIKE 'exact%' THEN 1 ELSE 0 END) AS BIGINT) AS exactness, CAST(sum(CASE WHEN channel = 'exact_alias' THEN 1 ELSE 0 END) AS BIGINT) AS alias_support FROM hit GROUP BY query_id, concept_id)"""


_RANKED = 'SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, exactness DESC, alias_support DESC, score DESC, concept_id) AS "rank" FROM ev'


@query(f'WITH {_retrieval_sql(False)} SELECT query_id, concept_id, score, channels, "rank" FROM ({_RANKED}) WHERE "rank" <= 20')
def search_index(spark, d):
    return retrieval.search(questions_of(spark, d), kb.postings(names_of(spark, d))).select("query_id", "concept_id", "score", joined("channels").alias("channels"), "rank")


@query(f'WITH {_retrieval_sql(True)} SELECT query_id, concept_id, score, tier, exactness, alias_support, "rank" FROM ({_RANKED}) WHERE "rank" <= 20')
def tiered_rank(spark, d):
    return retrieval.search(questions_of(spark, d), kb.postings(names_of(spark, d), tiered=True), tiered=True).select("query_id", "concept_id", "score", "tier", "exactness", "alias_support", "rank")


@query(f"WITH {_retrieval_sql(True)}, edge AS (SELECT a.concept_id AS src, b.concept_id AS dst FROM conc a JOIN conc b ON a.alias = b.alias AND a.concept_id <> b.concept_id) SELECT e.query_id, e.concept_id, (SELECT count(*) FROM edge g JOIN ev f ON f.concept_id = g.dst AND f.query_id = e.query_id WHERE g.src = e.concept_id) AS hierarchy FROM ev e")
def hierarchy_signal(spark, d):
    names = names_of(spark, d)
    one = names.select(F.col("concept_id").alias("src"), F.get("aliases", F.lit(0)).alias("a"))
    edges = one.join(one.select(F.col("src").alias("dst"), "a"), "a").where("src <> dst").select("src", "dst")
    return retrieval.evidence(questions_of(spark, d), kb.postings(names, tiered=True), edges, tiered=True).select("query_id", "concept_id", "hierarchy")


@query(f"SELECT DISTINCT q.p_name AS query_id, c.p_name || '/' || c.p_type AS concept_id FROM part q JOIN part c ON {snorm('q.p_name')} IN ({snorm('c.p_name')}, {snorm(chr(39) + chr(39) + ' || c.p_name || ' + chr(39) + ' ' + chr(39) + ' || lower(c.p_type)')})".replace("part q", "(SELECT DISTINCT p_name FROM part) q").replace("part c", "(SELECT DISTINCT p_name, p_type FROM part) c"))
def exact_alias(spark, d):
    return retrieval.exact_alias_ids(questions_of(spark, d), kb.postings(names_of(spark, d)))


@query(f"WITH g AS (SELECT n_name, {sgrams(spad('n_name'))} AS g FROM nation) SELECT a.n_name AS a, b.n_name AS b, round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 9) AS dice FROM g a, g b WHERE a.n_name <= b.n_name")
def dice(spark, d):
    n = read(spark, d, "nation").select("n_name", T.char_ngrams("n_name").alias("g"))  # 25 rows
    a, b = n.select(F.col("n_name").alias("a"), F.col("g").alias("ga")), n.select(F.col("n_name").alias("b"), F.col("g").alias("gb"))
    return a.join(F.broadcast(b), F.col("a") <= F.col("b")).select("a", "b", F.round(retrieval.dice(F.col("ga"), F.col("gb")), 9).alias("dice"))


@query(
    f"""WITH {_retrieval_sql(False)}, short AS (SELECT query_id, concept_id, "rank" AS shortlist_rank FROM ({_RANKED}) WHERE "rank" <= 50),
    qg AS (SELECT q, {sgrams(spad('q'))} AS g FROM quest), fg AS (SELECT concept_id, {sgrams(spad('form'))} AS g FROM nform),
    sim AS (SELECT s.query_id, s.concept_id, s.shortlist_rank, max(2.0 * len(list_intersect(qg.g, fg.g)) / (len(qg.g) + len(fg.g))) AS similarity FROM short s JOIN qg ON qg.q = s.query_id JOIN fg ON fg.concept_id = s.concept_id GROUP BY ALL)
    SELECT query_id, concept_id, round(similarity, 9) AS similarity, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, shortlist_rank, concept_id) AS "rank" FROM sim) WHERE "rank" <= 4"""
)
def sparse_search(spark, d):
    names = names_of(spark, d)
    rows = retrieval.sparse_search(questions_of(spark, d), kb.postings(names), names)
    return rows.select("query_id", "concept_id", F.round("similarity", 9).alias("similarity"), "rank")


def vectors_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(queries: every hundredth vector, all vectors); the label stands for the ontology."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("label").alias("ontology"), F.col("embedding").alias("vec"))
    return v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "concept_id")


_DENSE = """hits AS (SELECT query_id, concept_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id) AS "rank" FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS concept_id, list_reduce(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0))"""


@query(f'WITH {_DENSE} SELECT query_id, concept_id, round(score, 9) AS score, "rank" FROM hits WHERE "rank" <= 10')
def dense_topk(spark, d):
    q, v = vectors_of(spark, d)
    return retrieval.dense_topk(q, v).select("query_id", "concept_id", F.round("score", 9).alias("score"), "rank")


def hits_of(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows from events: a user asks, a value bucket is the concept, the type the retriever, the day part the view."""
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("query_id"), F.floor("value").cast("long").alias("concept_id"), F.col("event_type").alias("retriever"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("view"), (F.col("event_id") % 20 + 1).alias("rank"))


HITS = "h AS (SELECT user_id AS query_id, CAST(floor(value) AS BIGINT) AS concept_id, event_type AS retriever, 'v' || CAST(event_id % 3 AS VARCHAR) AS view, event_id % 20 + 1 AS rnk FROM events)"


@query(f"""WITH {HITS}, c AS (SELECT query_id, concept_id, count(DISTINCT retriever) AS retriever_count, count(DISTINCT view) AS view_count, min(rnk) AS best_rank, bool_or(retriever = 'purchase') AS exact_alias FROM h GROUP BY query_id, concept_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact_alias DESC, retriever_count DESC, view_count DESC, best_rank, concept_id) AS position FROM c) WHERE position <= 10""")
def candidate_union(spark, d):
    hits = hits_of(spark, d)
    return retrieval.capped(retrieval.candidate_union(hits, hits.where("retriever = 'purchase'"))).select("query_id", "concept_id", "retriever_count", "view_count", "best_rank", "exact_alias", "position")


@query(f"""WITH {HITS}, r AS (SELECT query_id, concept_id, retriever, min(rnk) AS rnk FROM h GROUP BY ALL), s AS (SELECT query_id, concept_id, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS score FROM r GROUP BY query_id, concept_id)
SELECT query_id, concept_id, round(score, 9) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id) AS position FROM s) WHERE position <= 10""")
def rrf(spark, d):
    return retrieval.fuse(hits_of(spark, d)).select("query_id", "concept_id", F.round("score", 9).alias("score"), "position")


# ---------------------------------------------------------------- linking


@query(f"""WITH {NOTES}, {TOK}, {ENT} SELECT doc_id, "start", "end", text AS mention, CASE type WHEN 'CHẨN_ĐOÁN' THEN 'ICD10' ELSE 'RXNORM' END AS ontology FROM ent WHERE type IN ('CHẨN_ĐOÁN', 'THUỐC')""")
def linkable(spark, d):
    docs = notes_of(spark, d)
    return linking.mentions(long_words(docs), docs).select("doc_id", "start", "end", "mention", "ontology")


_VIEWS = ("p_name", "CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE '  ' || p_type || '  ' END", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END")


@query(f"""WITH v AS (SELECT p_partkey, unnest([0, 1, 2]) AS k, unnest(['raw', 'canonical_vi', 'canonical_en']) AS view, unnest([{", ".join(ssqueeze(x) for x in _VIEWS)}]) AS t FROM part),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(t) ORDER BY k) AS n FROM v WHERE t <> '') WHERE n = 1) SELECT p_partkey, string_agg(view || '=' || t, '|' ORDER BY k) AS views FROM f GROUP BY p_partkey""")
def views(spark, d):
    v = linking.views(*[F.expr(x) for x in _VIEWS])
    return read(spark, d, "part").select("p_partkey", joined(F.transform(v, lambda x: F.concat_ws("=", x["view"], x["text"]))).alias("views"))


@query("""SELECT lower(substr(role, 1, 1)) AS r, text, count(*) AS uses FROM conversations GROUP BY role, text""")
def reformulation_cache(spark, d):
    rows = read(spark, d, "conversations").select("role", F.coalesce("text", F.lit("")).alias("text"))
    return linking.distinct_prompts(rows, ["role", "text"]).select(F.lower(F.substring("role", 1, 1)).alias("r"), "text", "uses")


_MENTION = "p_name || ' ' || CAST(p_size AS VARCHAR) || ' mg ' || CASE p_partkey % 5 WHEN 0 THEN 'viên nén' WHEN 1 THEN 'tiêm' WHEN 2 THEN 'siro uống' WHEN 3 THEN 'kem bôi' ELSE '' END"
_FORM = "CASE p_partkey % 4 WHEN 0 THEN 'Oral Tablet' WHEN 1 THEN 'Injection Solution' WHEN 2 THEN 'Topical Cream' ELSE '' END"


def pruned_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = read(spark, d, "part")
    kinds = F.when(F.col("p_partkey") % 11 == 0, "CHẨN_ĐOÁN").otherwise("THUỐC")
    rows = p.select(F.expr(_MENTION.replace("VARCHAR", "STRING")).alias("mention"), kinds.alias("type"), F.lit("RXNORM").alias("ontology"), F.col("p_partkey").cast("string").alias("concept_id"))
    governed = p.where("p_size <> 7").select(F.lit("RXNORM").alias("ontology"), F.col("p_partkey").cast("string").alias("concept_id"))
    strength = F.array(F.struct(((F.col("p_size") + F.col("p_partkey") % 2).cast("string")).alias("value"), F.lit("mg").alias("unit"), F.lit("").alias("raw")))
    drugs = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("concept_id"), strength.alias("strengths"), F.array(F.expr(_FORM)).alias("dose_forms"), F.lit("").alias("rxterm_form"))
    return rows, governed, drugs


def _said(vocabulary: dict[str, tuple[str, ...]]) -> str:
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(m, ' {w} ')" for w in ws) + f" THEN '{c}' END" for c, ws in vocabulary.items()) + "], lambda x: x IS NOT NULL)"


def _has(vocabulary: dict[str, tuple[str, ...]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(lower(f), '{c}') THEN '{c}' END" for c in vocabulary) + "], lambda x: x IS NOT NULL)"


_odd = lambda a, b: f"(len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}))"
_PRUNE = f"""x AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'CHẨN_ĐOÁN' ELSE 'THUỐC' END AS type, p_size = 7 AS out, p_partkey % 3 <> 0 AS drug, p_partkey % 2 = 1 AS other, ' ' || {ssqueeze(sfold(_MENTION))} || ' ' AS m, CASE WHEN p_partkey % 3 <> 0 THEN {_FORM} ELSE '' END AS f FROM part),
y AS (SELECT CAST(p_partkey AS VARCHAR) AS concept_id, CASE WHEN type <> 'THUỐC' THEN 'wrong_ontology' WHEN out THEN 'not_governed' WHEN drug AND other THEN 'strength_conflict' WHEN drug AND {_odd(_said(linking.FORM_WORDS), _has(linking.FORM_WORDS))} THEN 'dose_form_conflict' WHEN drug AND {_odd(_said(linking.ROUTE_WORDS), _has(linking.ROUTE_WORDS))} THEN 'route_conflict' END AS reason FROM x)"""


@query(f"WITH {_PRUNE} SELECT concept_id, reason FROM y")
def prune(spark, d):
    return linking.prune(*pruned_rows(spark, d)).select("concept_id", "reason")


@query(f"WITH {_PRUNE} SELECT reason, count(*) AS n FROM y WHERE reason IS NOT NULL GROUP BY reason")
def prune_counts(spark, d):
    return proposals.rejects(linking.prune(*pruned_rows(spark, d)))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS mention_id, 'order ' || CAST(l_orderkey AS VARCHAR) AS mention, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS concept_id FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY concept_id) - 1 AS k, count(*) OVER (PARTITION BY mention_id) AS n, CAST('0x' || substr(sha256(mention), 1, 8) AS BIGINT) AS h FROM c)
SELECT mention_id, concept_id, (k - h % n + n) % n AS position, chr(CAST(65 + (k - h % n + n) % n AS INT)) AS letter FROM k""")
def option_order(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("mention_id"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("mention"), F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("concept_id"))
    return linking.option_order(rows).select("mention_id", "concept_id", "position", "letter")


_REPLY = "CASE p_partkey % 9 WHEN 0 THEN 'A' WHEN 1 THEN ' [B] ' WHEN 2 THEN 'NONE' WHEN 3 THEN 'Z' WHEN 4 THEN 'A and B' WHEN 5 THEN '' WHEN 6 THEN 'J18.9' WHEN 7 THEN '[]' ELSE '1191' END"


@query(f"SELECT p_partkey AS mention_id, CASE WHEN p_partkey % 9 < 2 THEN 'SELECT' ELSE 'NONE' END AS decision, CASE p_partkey % 9 WHEN 0 THEN p_brand WHEN 1 THEN p_type END AS concept_id, CASE p_partkey % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'NONE' ELSE '' END AS letter, CASE p_partkey % 9 WHEN 3 THEN 'invalid_option' WHEN 4 THEN 'multiple_options' WHEN 5 THEN 'parse_failed' WHEN 6 THEN 'returned_a_code' WHEN 7 THEN 'parse_failed' WHEN 8 THEN 'returned_a_code' END AS reason FROM part")
def parse_selection(spark, d):
    p = read(spark, d, "part")
    replies = p.select(F.col("p_partkey").alias("mention_id"), F.expr(_REPLY).alias("reply"))
    options = p.select(F.col("p_partkey").alias("mention_id"), F.explode(F.array(F.struct(F.lit("A").alias("letter"), F.col("p_brand").alias("concept_id")), F.struct(F.lit("B").alias("letter"), F.col("p_type").alias("concept_id")))).alias("o")).select("mention_id", "o.*")
    return linking.parse_selection(replies, options).select("mention_id", "decision", "concept_id", "letter", "reason")


@query(f"WITH c AS ({SQL['candidate_union']}) SELECT query_id, concept_id, CASE WHEN exact_alias THEN 'exact_governed_alias' WHEN retriever_count >= 2 THEN 'independent_retriever_agreement' WHEN view_count >= 2 THEN 'independent_query_view_agreement' ELSE 'single_source_only' END AS reason FROM c")
def confidence(spark, d):
    return candidate_union(spark, d).select("query_id", "concept_id", linking.confidence(F.col("exact_alias"), F.col("retriever_count"), F.col("view_count")).alias("reason"))


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """One row an order and line number."""
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"), F.max("l_quantity").alias("l_quantity"))


OLINE = "oline AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(f"WITH {OLINE} SELECT l_orderkey AS doc_id, l_linenumber AS line, CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey AS VARCHAR) END AS code FROM oline")
def attach(spark, d):
    l = order_lines(spark, d)  # noqa: E741
    rows = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.lit("THUỐC").alias("type"))
    records = l.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.lit("THUỐC").alias("type"), F.array(F.col("l_partkey").cast("string")).alias("candidates"))
    return linking.attach(rows, records).select("doc_id", F.col("start").alias("line"), F.get("candidates", F.lit(0)).alias("code"))


# ---------------------------------------------------------------- validation and diagnostics

_ENTITY = """CASE p_partkey % 10
 WHEN 0 THEN '{"text": "' || p_name || '", "type": "THUỐC", "candidates": ["' || CAST(p_partkey AS VARCHAR) || '"], "assertions": [], "position": [0, ' || CAST(p_size AS VARCHAR) || ']}'
 WHEN 1 THEN '{"text": "' || p_name || '", "type": "THUỐC", "candidates": ["J18"], "assertions": ["isNegated", "isNegated"], "position": [5, 2]}'
 WHEN 2 THEN '{"text": "", "type": "TRIỆU_CHỨNG", "assertions": ["maybe"], "position": [0]}'
 WHEN 3 THEN '{"text": "x", "type": "DIAGNOSIS"}'
 WHEN 4 THEN '{"text": "x", "type": "TÊN_XÉT_NGHIỆM", "assertions": [], "position": [-1, 4]}'
 WHEN 5 THEN '{"text": "x", "type": "other", "position": [0, 1]}'
 WHEN 6 THEN '"text"'
 WHEN 7 THEN '{"text": "x", "type": "CHẨN_ĐOÁN", "candidates": [""], "assertions": {}, "position": [0, 1.5]}'
 WHEN 8 THEN '{"type": "KẾT_QUẢ_XÉT_NGHIỆM", "position": [true, false]}'
 ELSE '{"text": "x", "type": "CHẨN_ĐOÁN", "candidates": "A00", "assertions": ["isFamily", "isHistorical"], "position": [0, 1]}' END"""


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'duplicate_assertion|end_before_start|rxnorm_not_numeric' WHEN 2 THEN 'bad_position|bad_text|invalid_assertion' WHEN 3 THEN 'english_type' WHEN 4 THEN 'negative_start|unsupported_field:assertions'
 WHEN 5 THEN 'invalid_type' WHEN 6 THEN 'not_object' WHEN 7 THEN 'assertions_not_list|bad_position|candidate_not_str' WHEN 8 THEN 'bad_position|missing_field:text' ELSE 'candidates_not_list' END AS issues FROM part""")
def validate_entities(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.expr(_ENTITY.replace("VARCHAR", "STRING")).alias("entity"))
    return validation.entity_issues(rows).select("p_partkey", joined("issues").alias("issues"))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, 'missing_file' AS issue FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), 'unexpected_file' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def fileset_diff(spark, d):
    name = lambda t: read(spark, d, t).select(F.col("doc_id").cast("string").alias("name"))
    return validation.fileset_diff(name("labels"), name("documents"))


def coded_of(docs: DataFrame) -> DataFrame:
    """Long words with codes made from their length and place; some texts are cut wrongly."""
    code = F.concat(F.chr(F.lit(65) + F.col("start") % 26), F.lpad(((F.col("end") - F.col("start")) % 100).cast("string"), 2, "0"), F.when(F.col("start") % 3 == 0, ".123").when(F.col("start") % 3 == 1, ".1").otherwise(""))
    text = F.when(F.col("start") % 17 == 0, F.upper("text")).otherwise(F.col("text"))
    return long_words(docs).withColumn("candidates", F.array(code)).withColumn("text", text)


_CODED = """coded AS (SELECT doc_id, "start", "end", type, text AS t0, CASE WHEN "start" % 17 = 0 THEN upper(text) ELSE text END AS text, chr(CAST(65 + "start" % 26 AS INT)) || lpad(CAST(("end" - "start") % 100 AS VARCHAR), 2, '0') || CASE "start" % 3 WHEN 0 THEN '.123' WHEN 1 THEN '.1' ELSE '' END AS code FROM ent)"""
_GOV = "gov AS (SELECT DISTINCT 'ICD10' AS o, replace(code, '.', '') AS c FROM coded WHERE code LIKE 'A%' OR code LIKE 'B%')"


@query(
    f"""WITH {DOCS}, {TOK}, {ENT}, {_CODED}, {_GOV} SELECT doc_id, "start", "end", 'offsets_do_not_match' AS issue FROM coded WHERE text <> t0
    UNION ALL SELECT doc_id, "start", "end", 'not_dotted' FROM coded WHERE type = 'CHẨN_ĐOÁN' AND NOT regexp_matches(code, '{validation.DOTTED_OUTPUT}')
    UNION ALL SELECT doc_id, "start", "end", 'ungoverned_code' FROM coded WHERE type = 'CHẨN_ĐOÁN' AND regexp_matches(code, '{validation.DOTTED_OUTPUT}') AND replace(code, '.', '') NOT IN (SELECT c FROM gov)
    UNION ALL SELECT doc_id, "start", "end", 'ungoverned_code' FROM coded WHERE type = 'THUỐC'"""
)
def governed_gate(spark, d):
    docs = docs_of(spark, d)
    rows = coded_of(docs)
    code = F.get("candidates", F.lit(0))
    governed = rows.where(code.startswith("A") | code.startswith("B")).select(F.lit("ICD10").alias("ontology"), F.replace(code, F.lit("."), F.lit("")).alias("concept_id")).distinct()
    return validation.governed_issues(rows, docs, governed)


@query(f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN coalesce(dotted, '?') ELSE code END AS code FROM ({SQL['icd_dotting']}) JOIN part USING (p_partkey)")
def derive_codes(spark, d):
    kind = F.when(F.col("p_size") % 2 == 0, "CHẨN_ĐOÁN").otherwise("THUỐC")
    rows = read(spark, d, "part").select("p_partkey", kind.alias("type"), F.array(F.expr(_CODE_SPARK), F.lit("A00")).alias("candidates"))
    return validation.derive_codes(rows, keep=1, strict=False).select("p_partkey", F.coalesce(F.get("candidates", F.lit(0)), F.lit("?")).alias("code"))


@query(f"""WITH {OLINE} SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS idx, unnest(list_filter([CASE WHEN l_linenumber = 7 THEN 'row' WHEN l_quantity > 45 THEN 'text' END, CASE WHEN l_linenumber < 7 AND l_returnflag = 'R' THEN 'type' END], lambda x: x IS NOT NULL)) AS field FROM oline""")
def derivation_diff(spark, d):
    rows = order_lines(spark, d)
    key = [F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("idx")]
    a = rows.select(*key, F.col("l_quantity").cast("string").alias("text"), F.col("l_returnflag").alias("type"), F.array(F.lit("x")).alias("candidates"))
    text = F.when(F.col("l_quantity") > 45, "changed").otherwise(F.col("l_quantity").cast("string"))
    b = rows.where("l_linenumber < 7").select(*key, text.alias("text"), F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_returnflag")).alias("type"), F.array(F.lit("y")).alias("candidates"))
    return validation.derivation_diff(a, b)


@query("SELECT s_name AS model, 'licence_review' AS issue FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_name, 'revision_not_pinned' FROM supplier WHERE s_nationkey >= 10 UNION ALL SELECT '*', 'over_cap' FROM (SELECT sum(s_suppkey) * 1000000000 AS n FROM supplier) WHERE n >= 9000000000")
def model_budget(spark, d):
    rows = read(spark, d, "supplier").select(F.col("s_name").alias("model"), (F.col("s_suppkey") * 1_000_000_000).alias("parameters"), (F.col("s_acctbal") >= 0).alias("licence_cleared"), F.when(F.col("s_nationkey") < 10, F.sha1(F.encode("s_name", "UTF-8"))).otherwise(F.lit("main")).alias("revision"))
    return validation.budget_issues(rows)


@query(f"""WITH m AS ({SQL['pool_merge']}), b AS (SELECT CASE WHEN contains(sources, '|') THEN 'agreement' WHEN sources = 'e3' THEN 'e3_only' WHEN sources = 'qwen_context' THEN 'qwen_only' ELSE 'alias_only' END AS bucket, type FROM m)
SELECT 'bucket_' || bucket AS counter, count(*) AS n FROM b GROUP BY bucket UNION ALL SELECT 'type_' || type, count(*) FROM b GROUP BY type UNION ALL SELECT 'all', count(*) FROM b""")
def run_diagnostics(spark, d):
    rows = pooled_of(docs_of(spark, d))
    buckets = rows.withColumn("bucket", diagnostics.source_bucket(F.col("sources")))
    return diagnostics.counters(diagnostics.count_of(buckets, "bucket", "bucket"), diagnostics.count_of(rows, "type", "type"), diagnostics.count_of(rows, "all"))


@query(f"WITH {HITS}, s AS (SELECT query_id, count(DISTINCT concept_id) AS n FROM h GROUP BY query_id) SELECT count(*) AS mentions, CAST(sum(n) AS BIGINT) AS candidates, round(avg(n), 9) AS mean_union_size FROM s")
def link_diagnostics(spark, d):
    return diagnostics.mean_union_size(retrieval.candidate_union(hits_of(spark, d))).select("mentions", "candidates", F.round("mean_union_size", 9).alias("mean_union_size"))


# ---------------------------------------------------------------- replies and pipelines


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated_before_json_closed' WHEN 2 THEN 'no_json_object_found' WHEN 3 THEN 'ok' WHEN 4 THEN 'json_not_an_entity_list' ELSE 'empty_reply' END AS category, CAST(CASE (conv_id + turn) % 6 WHEN 0 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS kept FROM conversations""")
def json_extract(spark, d):
    row = F.to_json(F.struct(F.lit("L001").alias("line_id"), F.concat(F.lit("x "), F.coalesce("text", F.lit(""))).alias("text"), F.lit("THUỐC").alias("type"), F.lit(0).alias("occurrence")))
    good = F.concat(F.lit('{"entities": ['), row, F.lit("]}"))
    k = (F.col("conv_id") + F.col("turn")) % 6
    reply = F.when(k == 0, F.concat(F.lit("Here: "), good)).when(k == 1, F.expr("concat('{\"entities\": [', '{\"text\": \"a\"')")).when(k == 2, "nothing").when(k == 3, F.concat(F.lit("<think>{no}</think>```json\n"), good, F.lit("\n```"))).when(k == 4, '{"a": 1}').otherwise("<think>never ends")
    rows = read(spark, d, "conversations").select("conv_id", "turn", models.parse_pass(F.lit("medication"), reply).alias("p"))
    return rows.select("conv_id", "turn", "p.category", F.size("p.rows").cast("long").alias("kept"))


def _seeds(docs: DataFrame) -> DataFrame:
    return long_words(docs)


@query()
def pipeline_extract(spark, d):
    """Extraction without a model: seeds and governed phrases to asserted entities."""
    docs = notes_of(spark, d)
    rows = pipeline.extract(docs, _seeds(docs), lexicon.build_lexicon(concepts_of(spark, d), max_concepts=1000, max_share=1.0))
    return rows.select("doc_id", "start", "end", "text", "type", joined("sources").alias("sources"), joined("assertions").alias("assertions"), "reason")


def first_option():
    """A responder that answers every choice with option A, and every reformulation with nothing."""
    return lambda prompt: "A" if prompt.startswith("Choose") else "{}"


@query()
def pipeline_link(spark, d):
    """Linking of the benchmark phrases found in the documents, with a responder that takes the first option."""
    docs, concepts = docs_of(spark, d), concepts_of(spark, d)
    hits = lexicon.alias_hits(docs, lexicon.build_lexicon(concepts, max_concepts=1000, max_share=1.0))
    entities = hits.select("doc_id", "start", "end", "text", F.col("entity_type").alias("type"))
    drugs = spark.createDataFrame([], "concept_id string, strengths array<struct<value:string,unit:string,raw:string>>, dose_forms array<string>, rxterm_form string")
    rows = pipeline.link(entities, docs, concepts, kb.postings(concepts), drugs, first_option)
    return rows.select("doc_id", "start", "end", "text", "decision", "concept_id", "link_reason", joined(F.coalesce("candidates", F.array().cast("array<string>"))).alias("candidates"))
