"""Privacy, export, CSV round trips, file audits and header catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.fixed_values import CONCEPTS, HEADER_ALIASES, RULE_INPUTS
from folioguard.functions.scalars import n_if
from folioguard.operators import headers as H
from folioguard.operators import privacy as V
from folioguard.operators.rules import rule_readiness
from folioguard.plans.registry import query
from folioguard.session import staging_path
from folioguard.sources import artifacts as A
from folioguard.sources import csv as C
from folioguard.sources import intake as I
from folioguard.sources.portfolio import table

# The value patterns without look-around, for an engine that has none.
_EDGE, _DIGIT_EDGE = r"(^|[^\p{L}\p{N}_])", r"(^|[^0-9])"
_TAIL, _DIGIT_TAIL = r"($|[^\p{L}\p{N}_])", r"($|[^0-9])"
_SQL_PATTERNS = {
    "email_pattern": rf"(?i)(^|[^\p{{L}}\p{{N}}_])[\p{{L}}\p{{N}}_]?[a-z0-9.!#$%&''*+/=?^_`{{|}}~-]*"
                     rf"[a-z0-9_]*@[a-z0-9-]+(\.[a-z0-9-]+)+",
    "international_phone_pattern": rf"{_EDGE}\+[0-9][0-9\s().-]{{7,}}[0-9]{_TAIL}",
    "nigerian_phone_pattern": rf"{_DIGIT_EDGE}0(70|71|80|81|90|91)[0-9]{{8}}{_DIGIT_TAIL}",
    "iban_pattern": rf"(?i){_EDGE}[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}{_TAIL}",
}
# Whole cells are matched, so the plain e-mail pattern serves here too: word edges differ only next to letters
# outside ASCII, which the look at both sides below rules out.
_SQL_PATTERNS["email_pattern"] = (
    r"(?i)(^|[^a-z0-9\p{L}\p{N}_.!#$%&''*+/=?^`{|}~-]|[.!#$%&''*+/=?^`{|}~-])[a-z0-9_]"
    r"[a-z0-9.!#$%&''*+/=?^_`{|}~-]*@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z0-9-]*[a-z0-9]"
    r"($|[^\p{L}\p{N}_])")


def _hit(name: str, column: str = "text") -> str:
    return f"regexp_matches({column}, '{_SQL_PATTERNS[name]}')"


_ANY = " or ".join(_hit(n) for n in _SQL_PATTERNS)


@query("f3_value_patterns", "select doc_id, " + ", ".join(
    f"cast({_hit(n)} as int) {n}" for n in _SQL_PATTERNS) + " from documents")
def f3_value_patterns(spark, sf_dir):
    from folioguard.fixed_values import VALUE_PATTERNS

    return table(spark, sf_dir, "documents").select("doc_id", *[
        V.matches(F.col("text"), p).cast("int").alias(n) for n, _, p in VALUE_PATTERNS])


def _private_documents(spark, sf_dir):
    """Documents with two restricted headers among the columns."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("Phone Number"), F.col("source").alias("surname"), "text", "n_chars")


@query("a34_privacy_findings", """with f as (
 select 0 ordinal, 'contact' category, 'Phone Number' "column", 'restricted_column' detection,
  (select count(*) from documents) affected_rows
 union all select 1, 'direct_identifier', 'surname', 'restricted_column', (select count(*) from documents)
 """ + " ".join(
    f"union all select {i}, '{'financial_account' if n == 'iban_pattern' else 'contact'}', 'text', '{n}', "
    f"(select count(*) from documents where {_hit(n)})" for i, n in enumerate(_SQL_PATTERNS, 2)) + """)
 select *, (select count(*) from documents) inspected_rows from f where affected_rows>0""")
def a34_privacy_findings(spark, sf_dir):
    return V.privacy_findings(_private_documents(spark, sf_dir))


@query("p13_restricted_columns_dropped", "select doc_id, text, n_chars from documents")
def p13_restricted_columns_dropped(spark, sf_dir):
    return V.minimize(_private_documents(spark, sf_dir), inspect_values=False)


@query("f4_redacted_cells", f"select doc_id, case when {_ANY} then '[REDACTED]' else text end as text, n_chars "
                            "from documents")
def f4_redacted_cells(spark, sf_dir):
    return V.minimize(_private_documents(spark, sf_dir))


@query("f4_redacted_conversations",
       f"select conv_id, turn, role, case when {_ANY} then '[REDACTED]' else text end as text from conversations")
def f4_redacted_conversations(spark, sf_dir):
    return V.minimize(table(spark, sf_dir, "conversations"))


@query("t7_inspection_bound", f"""select count(*) inspected_rows,
 count(*) filter (where {_hit('email_pattern')}) with_email from conversations""")
def t7_inspection_bound(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    from folioguard.fixed_values import VALUE_PATTERNS

    return rows.agg(
        F.count("*").alias("inspected_rows"),
        n_if(V.matches(F.col("text"), VALUE_PATTERNS[0][2])).alias("with_email"))


# Every way a cell can start, in front of whole document texts.
_PREFIX_SQL = """case doc_id%9 when 0 then '=' when 1 then '+' when 2 then '-' when 3 then '@' when 4 then chr(9)
 when 5 then concat(' ', chr(9), '=') when 6 then chr(13) when 7 then concat('x', '=') else '' end"""


def _formula_cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.expr(_PREFIX_SQL), F.col("text")).alias("cell"), "n_chars")


@query("f5_formula_cells", f"""with t as (select doc_id, concat({_PREFIX_SQL}, text) cell, n_chars from documents)
 select doc_id, case when left(cell,1) in (chr(9), chr(13))
  or left(ltrim(cell, concat(' ', chr(9), chr(13), chr(10))),1) in ('=','+','-','@')
  then concat('''', cell) else cell end cell, n_chars from t""")
def f5_formula_cells(spark, sf_dir):
    return V.safe_cells(_formula_cells(spark, sf_dir))


# Cells that a careless reader would change.
_LEXICAL = {
    "order_code": "concat('00', cast(o_orderkey as varchar(20)))",
    "amount_text": "case when o_orderkey%4=0 then '' when o_orderkey%4=1 then 'N/A' "
                   "else cast(o_orderkey as varchar(20)) end",
    "note": "case when o_orderkey%5=0 then ' padded ' when o_orderkey%5=1 then 'say \"hi\", twice' "
            "when o_orderkey%5=2 then concat('two', chr(10), 'lines') when o_orderkey%5=3 then 'semi;colon' "
            "else 'None' end",
    "flag": "case when o_orderkey%2=0 then 'True' else 'false' end",
}
_LEXICAL_SQL = ", ".join(f"{e} as {n}" for n, e in _LEXICAL.items())


def _staged_csv(spark, sf_dir, label: str, delimiter: str = ",") -> str:
    rows = table(spark, sf_dir, "orders").select([F.expr(e).alias(n) for n, e in _LEXICAL.items()])
    path = staging_path(spark, label)
    rows.toDF("Order Code", "Amount Text", "Note", "Flag").write.options(
        header=True, sep=delimiter, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query("s2_lexical_csv", f"select {_LEXICAL_SQL} from orders")
def s2_lexical_csv(spark, sf_dir):
    return C.read_lexical(spark, _staged_csv(spark, sf_dir, "lexical", ";"), delimiter=";")


@query("s1_typed_csv", """select 'x' as keep, concat('00', cast(o_orderkey as varchar)) code_text,
 case when o_orderkey%4<2 then null else cast(o_orderkey as double) end amount_text,
 case when o_orderkey%5=4 then null else 'text' end note, o_orderkey%2=0 as flag from orders""")
def s1_typed_csv(spark, sf_dir):
    typed = C.read_typed(spark, _staged_csv(spark, sf_dir, "typed"))
    # The code is an integer to the typed reader; two zeros in front are gone, as they are for any such reader.
    return typed.select(
        F.lit("x").alias("keep"), F.concat(F.lit("00"), F.col("order_code").cast("string")).alias("code_text"),
        "amount_text", F.when(F.col("note").isNotNull(), "text").alias("note"), "flag")


@query("s3_trusted_csv", "select cast(o_orderkey as bigint) amount, cast(o_custkey as bigint) amount_2, "
                         "o_orderstatus status from orders")
def s3_trusted_csv(spark, sf_dir):
    path = staging_path(spark, "trusted")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows.toDF("Amount", "amount ", "Status").write.options(header=True).csv(path)
    return C.read_trusted(spark, path)


@query("s7_row_bound", """select 'orders' as dataset, case when count(*)>100000 then 'too_many_rows' when count(*)=0
 then 'empty_file' else 'accepted' end verdict, least(count(*),100001) counted_rows from orders
 union all select 'lineitem', case when count(*)>500 then 'too_many_rows' else 'accepted' end, least(count(*),501)
 from lineitem""")
def s7_row_bound(spark, sf_dir):
    orders = C.row_bound(table(spark, sf_dir, "orders")).withColumn("dataset", F.lit("orders"))
    lines = C.row_bound(table(spark, sf_dir, "lineitem"), 500).withColumn("dataset", F.lit("lineitem"))
    return orders.unionByName(lines)


@query("s12_safe_csv_export", f"""with t as (select doc_id, replace(concat({_PREFIX_SQL}, text), chr(13), ' ') cell,
 n_chars from documents), r as (select doc_id, n_chars, case when {_ANY.replace('(text,', '(cell,')}
 then '[REDACTED]' else cell end cell from t)
 select cast(doc_id as varchar) doc_id, cast(n_chars as varchar) n_chars, case when left(cell,1)=chr(9)
  or left(ltrim(cell, concat(' ', chr(9), chr(10))),1) in ('=','+','-','@') then concat('''', cell) else cell end cell
 from r""")
def s12_safe_csv_export(spark, sf_dir):
    # A reader may turn a bare carriage return into a line feed, so the round trip writes a space for it.
    rows = _formula_cells(spark, sf_dir).withColumn("cell", F.regexp_replace("cell", "\r", " "))
    path = staging_path(spark, "export")
    C.write_safe_csv(rows, path, privacy=True)
    return C.read_lexical(spark, path)


@query("s8_s9_lexical_artifact", "select concat('00', cast(o_orderkey as varchar)) order_code, "
                                 "case when o_orderkey%2=0 then 'True' else 'false' end flag from orders")
def s8_s9_lexical_artifact(spark, sf_dir):
    lexical = C.read_lexical(spark, _staged_csv(spark, sf_dir, "source"))
    catalogue = A.write_artifact(
        lexical, staging_path(spark, "artifact"), "version-1", ["Order Code", "Amount Text", "Note", "Flag"])
    return A.read_artifact(catalogue, ["order_code", "flag"])


# Whole documents as files, one defect in each of nine kinds.
_BODY = "regexp_replace(text, '[^A-Za-z0-9 ]', ' '{g})"
_KIND = {
    0: ("", None, "empty_file"),
    1: ("Customer ID,Amount\\n1,{b}\\n", None, "unsupported_extension"),
    2: ("a,b\\n1,{b}", "00", "binary_content"),
    3: ("a,b\\n1,{b}", "FF", "invalid_encoding"),
    5: ("Amount ,amount\\n1,{b}\\n", None, "header_collision"),
    6: ("Amount,,x\\n1,2,{b}\\n", None, "empty_header"),
    7: ("Amount,Note\\n1,\\\"{b}", None, "parse_failed"),
    8: ("a^b\\n1^{b}\\n", None, "unsupported_delimiter"),
    9: ("Customer ID,Amount\\n1,{b}\\n", None, None),
}


def _text_expr(template: str, body: str) -> str:
    """``concat`` of the template's pieces in SQL, line feeds and quotes spelled by code."""
    parts = []
    for piece in template.replace("\\n", "\0n\0").replace('\\"', '\0q\0').replace("{b}", "\0b\0").split("\0"):
        parts.append({"n": "chr(10)", "q": "chr(34)", "b": body}.get(piece, f"'{piece}'") if piece else "''")
    return f"concat({', '.join(parts)})"


def _contents(body: str, encode: str, blob: str) -> str:
    """CASE over the kinds giving bytes; kind 4 is a file with a byte-order mark and CRLF line ends."""
    cases = []
    for kind, (template, tail, _) in _KIND.items():
        text = encode.format(_text_expr(template, body))
        cases.append(f"when {kind} then {text if tail is None else f'{text} || ' + blob.format(tail)}")
    marked = (f"concat('Customer ID;Transaction Amount', chr(13), chr(10), cast(doc_id as varchar(20)), ';', {body}, "
              "chr(13), chr(10))")
    cases.append(f"when 4 then {blob.format('EFBBBF')} || {encode.format(marked)}")
    return f"case doc_id%10 {' '.join(cases)} end"


_PATH = "concat('landing/', source, '/', cast(doc_id as varchar(20)), case when doc_id%10=1 then '.txt' else '.csv' end)"
_SPARK_CONTENT = _contents(_BODY.format(g=""), "encode({}, 'utf-8')", "X'{}'")
_DUCK_CONTENT = _contents(_BODY.format(g=", 'g'"), "encode({})", "unhex('{}')")
_ERROR = "case doc_id%10 " + " ".join(
    f"when {k} then {'null' if e is None else repr(e)}" for k, (_, _, e) in _KIND.items()) + " end"


def _document_files(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.expr(_PATH).alias("path"), F.expr(_SPARK_CONTENT).alias("content"))
    return rows.select("path", F.octet_length("content").cast("long").alias("length"), "content")


@query("s4_file_audit", f"""with f as (select doc_id, {_PATH} path, {_DUCK_CONTENT} content from documents)
 select path, octet_length(content) length, sha256(content) sha256, case when doc_id%10 in (2,3) then null
  when doc_id%10=4 then 'utf-8-sig' else 'utf-8' end encoding, {_ERROR} error_code from f""")
def s4_file_audit(spark, sf_dir):
    return I.audit_files(_document_files(spark, sf_dir)).select("path", "length", "sha256", "encoding", "error_code")


_RANGE_BYTES = 1 << 20


def _quoted_files(spark, sf_dir, label: str) -> str:
    """Whole documents as CSV files of one folder a language; quoted cells hold quotes, marks and line ends."""
    rows = table(spark, sf_dir, "documents").select(
        F.coalesce("lang", F.lit("none")).alias("folder"), F.col("doc_id").cast("string").alias("Doc Id"),
        F.coalesce("text", F.lit("")).alias("Whole Text"), F.coalesce("source", F.lit("")).alias("Source"))
    path = staging_path(spark, label)
    rows.write.partitionBy("folder").options(
        header=True, quote='"', escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query("s4_audit_in_ranges", """select coalesce(lang, 'none') as folder, count(*) data_rows, cast(3 as bigint) columns,
 cast(0 as bigint) refused from documents group by 1""")
def s4_audit_in_ranges(spark, sf_dir):
    """Files of any size, audited in byte ranges that start inside and outside quotes."""
    audited = I.audit_large_files(spark, _quoted_files(spark, sf_dir, "quoted"), I.FilePolicy(2**60, 2**62), _RANGE_BYTES)
    return audited.groupBy(F.regexp_extract("path", "folder=([^/]*)/", 1).alias("folder")).agg(
        F.sum("data_rows").alias("data_rows"), F.max("column_count").cast("bigint").alias("columns"),
        F.count("error_code").alias("refused"))


@query("s2_split_records", """select cast(doc_id as varchar) doc_id, coalesce(text, '') whole_text, coalesce(source, '') source
 from documents""")
def s2_split_records(spark, sf_dir):
    """The rows of those files, read in ranges."""
    return C.read_lexical(spark, _quoted_files(spark, sf_dir, "split"), range_bytes=_RANGE_BYTES)


@query("s5_delimiters", f"""select {_PATH} path, case doc_id%10 when 2 then null when 3 then null when 4 then ';'
 when 8 then 'unsupported' else ',' end delimiter from documents""")
def s5_delimiters(spark, sf_dir):
    return I.audit_files(_document_files(spark, sf_dir)).select("path", "delimiter")


@query("s6_header_checks", f"""select {_PATH} path, case doc_id%10 when 0 then 'unnamed' when 1 then 'customer_id|amount'
 when 4 then 'customer_id|transaction_amount' when 5 then 'amount|amount' when 6 then 'amount|unnamed|x'
 when 7 then 'amount|note' when 8 then 'a_b' when 9 then 'customer_id|amount' end headers,
 case doc_id%10 when 0 then 1 when 2 then null when 3 then null when 6 then 3 when 8 then 1 else 2 end column_count,
 cast(case doc_id%10 when 0 then -1 when 2 then null when 3 then null else 1 end as bigint) data_rows
 from documents""")
def s6_header_checks(spark, sf_dir):
    audited = I.audit_files(_document_files(spark, sf_dir))
    return audited.select("path", F.array_join("normalized_headers", "|").alias("headers"), "column_count", "data_rows")


# A catalogue of source headers: eight per customer, drawn from known names, aliases and others.
HEADER_POOL = (
    " Customer ID ", "TXN-Value", "ccy", "Principal (NGN)", "principal", "Region", "is_default", "Loan Status",
    "transaction.date", "Monthly  Income", "***", "Debt Balance", "amount", "Amount", "Borrower_ID", "Notes #2",
    "REPAYMENT SCORE", "income", "Currency", "client-id",
)
_POOL_SQL = "case (c_custkey*7+position*position*3)%20 " + " ".join(
    f"when {i} then '{h}'" for i, h in enumerate(HEADER_POOL)) + " end"
_HEADERS_SQL = f"""h as (select c_custkey dataset_id, position, {_POOL_SQL} source_column from (
 select c_custkey, cast(unnest(generate_series(1,8)) as int) as position from customer)),
 n as (select *, coalesce(nullif(trim(regexp_replace(lower(trim(source_column)),'[^0-9a-z]+','_','g'),'_'),''),
  'unnamed') normalized_column from h)"""
_KNOWN_SQL = " union all ".join(
    [f"select '{c}' k, '{c}' concept, 1.0 conf" for c in CONCEPTS]
    + [f"select '{a}', '{c}', 0.85" for a, c in HEADER_ALIASES.items()])


def header_catalogue(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(8))).alias(
        "position"))
    return H.normalize_headers(rows.select(
        F.col("c_custkey").alias("dataset_id"), "position", F.expr(_POOL_SQL).alias("source_column")))


@query("h1_header_normal_form", f"with {_HEADERS_SQL} select * from n")
def h1_header_normal_form(spark, sf_dir):
    return header_catalogue(spark, sf_dir)


@query("h2_w4_collision_suffixes", f"""with {_HEADERS_SQL}, r as (select *, row_number() over (partition by dataset_id,
 normalized_column order by position) rn from n) select dataset_id, position, source_column, normalized_column,
 case when rn=1 then normalized_column else concat(normalized_column,'_',rn) end unique_column from r""")
def h2_w4_collision_suffixes(spark, sf_dir):
    return H.suffix_collisions(header_catalogue(spark, sf_dir), ["dataset_id"])


_RULE_COLUMNS = ", ".join(f"case when not list_contains(c, '{c}') then '{c}' end" for c in RULE_INPUTS)


@query("r16_rule_readiness", f"""with h as (select dataset_id, normalized_column from ({{base}})),
 d as (select dataset_id, list(normalized_column) c from h group by 1),
 m as (select dataset_id, array_to_string(list_filter([{_RULE_COLUMNS}], lambda x: x is not null), ', ') missing_inputs from d)
 select dataset_id, case when missing_inputs='' then 'ready' else 'blocked' end status, missing_inputs,
 case when missing_inputs<>'' then concat('Risk rule evaluation is blocked: Risk-rule evaluation is missing required inputs: ',
  missing_inputs, '.') end message from m""".replace("{base}", f"""select c_custkey dataset_id,
  unnest(list_filter([{', '.join(f"case when (c_custkey*{i + 3}+{i})%{i + 7}>0 then '{c}' end" for i, c in enumerate(RULE_INPUTS))},
   'note'], lambda x: x is not null)) normalized_column from customer"""))
def r16_rule_readiness(spark, sf_dir):
    """Datasets that lack one rule input or another, and what the guard says of each."""
    names = F.array(*[F.when(F.expr(f"(c_custkey*{i + 3}+{i})%{i + 7}>0"), F.lit(c)) for i, c in enumerate(RULE_INPUTS)],
                    F.lit("note"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("dataset_id"), F.explode(F.array_compact(names)).alias("normalized_column"))
    return rule_readiness(rows)


@query("h3_concept_suggestions", f"""with {_HEADERS_SQL}, k as ({_KNOWN_SQL}) select dataset_id, position, source_column,
 normalized_column, concept suggested_concept, cast(coalesce(conf,0) as double) confidence, case when concept is null
 then 'unmapped' else 'suggested' end status, cast(concept is not null as int) confirmation_required
 from n left join k on normalized_column=k.k""")
def h3_concept_suggestions(spark, sf_dir):
    found = H.suggest_concepts(header_catalogue(spark, sf_dir))
    return found.withColumn("confirmation_required", F.col("confirmation_required").cast("int"))


@query("h6_schema_fingerprints", f"""with {_HEADERS_SQL}, j as (select dataset_id, count(*) column_count, concat(
 '{{"fields":[', string_agg(concat('{{"normalized":"',normalized_column,
 '","nullable":false,"physical_type":"string","source":"',source_column,'"}}'), ',' order by position),
 '],"normalization_version":"1"}}') payload from n group by 1)
 select dataset_id, sha256(payload) schema_fingerprint, column_count from j""")
def h6_schema_fingerprints(spark, sf_dir):
    return H.schema_fingerprints(header_catalogue(spark, sf_dir), ["dataset_id"])


@query("f12_masked_hashes", "select doc_id, sha256(text) digest, concat('sha256:', left(sha256(text),16)) masked "
                            "from documents")
def f12_masked_hashes(spark, sf_dir):
    from folioguard.functions.hashing import masked

    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("digest"), masked(F.col("text")).alias("masked"))
