"""The named queries of the table-span operators, and the SQL that gives the same rows.

Every query runs over its whole table.  ``pages`` supply both sides: a page is the text, and the lines of its
``<nav>`` are the table that a peer supplies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.normalize import folded_text, legacy_body, legacy_folded_text, token_kind, token_offsets, tokens
from tabloom.functions.peers import peer_contents
from tabloom.operators.legacy import legacy_bodies, with_legacy_segments
from tabloom.operators.locate import candidate_windows, exact_start
from tabloom.operators.matching import with_matches
from tabloom.operators.passages import passages_in
from tabloom.operators.segments import chosen_spans, cut_text
from tabloom.operators.spans import header_and_body
from tabloom.plans.extract import extract_tables, flat_metrics, summary
from tabloom.sources.jsonl import numbered_lines
from tabloom.sources.parquet import spread


def page_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ctt, content): each page and the lines of its navigation, with the breaks of a table."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    lines = F.regexp_replace(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1), r"</li>\s*<li>", "<br>")
    return pages.select("page_id", F.col("html").alias("ctt"), lines.alias("content"))


def _records(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """Records of pages with one peer, or with those that ``more`` makes of it, nulls left out."""
    peers = page_peers(spark, sf_dir)
    made = [m(F.col("content")) for m in more] or [F.col("content")]
    return peers.select("page_id", "ctt", F.filter(F.array(*made), lambda x: x.isNotNull()).alias("tabel_info"))


def _turn(of: int, *choices):
    """Of ``choices`` the one whose turn it is by the page's id; the last for all others."""
    out = choices[-1]
    for i, c in enumerate(choices[:-1]):
        out = F.when(F.col("page_id") % of == i, c).otherwise(out)
    return out


def _title(html):
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def _matched(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    return with_matches(_records(spark, sf_dir, *more), "ctt", "tabel_info")


def _first(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    m = F.col("__matches")[0]
    return _matched(spark, sf_dir).select("page_id", *[m[f].alias(f) for f in fields])


def q01_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("k", lambda x: x == kind)).cast("long").alias(f"{kind}_tokens")

    kinds = page_peers(spark, sf_dir).select("page_id", F.transform(tokens(F.col("ctt")), token_kind).alias("k"))
    return kinds.select("page_id", count("tag"), count("entity"), count("text"))


def q02_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_peers(spark, sf_dir).select("page_id", folded_text(F.col("ctt")).alias("n")).select("page_id", F.length("n").cast("long").alias("chars"), F.md5("n").alias("digest"))


def q03_offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every 100th folded character of every page comes from."""
    places = offset_maps(page_peers(spark, sf_dir).select("page_id", "ctt")).select("page_id", F.posexplode("offsets").alias("pos", "at"))
    return places.where("pos % 100 = 0").select("page_id", F.col("pos").cast("long").alias("pos"), F.col("at").cast("long").alias("at"))


def q04_peer_contents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents from JSON text that also holds a number, a null content, a blank one and an object without any."""
    item = F.to_json(F.struct(F.col("content")))
    text = F.concat(F.lit('[1,{"content":null},'), item, F.lit(',{"content":"<br>"},{"x":1},{"content":"tail"}]'))
    base = page_peers(spark, sf_dir).withColumn("tabel_info", text)
    found = base.select("page_id", peer_contents(F.col("tabel_info"), base.schema["tabel_info"].dataType).alias("c"))
    return found.select("page_id", F.posexplode("c").alias("table_idx", "content")).select("page_id", F.col("table_idx").cast("long"), F.md5("content").alias("digest"))


def q05_split_header_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = page_peers(spark, sf_dir).select("page_id", header_and_body(F.col("content")).alias("x"))
    return base.select("page_id", F.col("x.body").alias("body"), F.col("x.header").cast("long").alias("header_chars"))


def q06_locate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = page_peers(spark, sf_dir).select("page_id", folded_text(F.col("ctt")).alias("s"), folded_text(F.col("content")).alias("q"))
    return base.select("page_id", exact_start(F.col("s"), F.col("q")).cast("long").alias("at"), F.length("q").cast("long").alias("chars"))


def q07_full_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, "full_start", "full_end")


def q08_body_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, "body_start", "body_end")


def q09_extracted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, "extracted_table")


def q10_flat_metrics_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flat_metrics(extract_tables(_records(spark, sf_dir)), "page_id")
    spans = {f"{n}_{e}": F.col(f"{n}_span")[i] for n in ("full", "body") for i, e in enumerate(("start", "end"))}
    return flat.withColumns(spans).drop("full_span", "body_span")


def q11_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other page's peer is a table that occurs nowhere."""
    flat = flat_metrics(extract_tables(_records(spark, sf_dir, lambda c: _turn(2, F.lit("@@none@@<br>zzz"), c))), "page_id")
    return flat.select("page_id", "peer_body", "matched", "extracted_table", "similarity", "match_score", "match_mode", F.col("full_span").isNull().alias("no_span"))


def q12_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = extract_tables(_records(spark, sf_dir)).select("page_id", F.posexplode(F.arrays_zip("text_list", "type_list")).alias("seq", "x"))
    return pieces.select("page_id", F.col("seq").cast("long"), F.col("x.type_list").alias("type"), F.md5("x.text_list").alias("digest"))


def q13_segments_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces around two tables add up to the page; where they are cut is in their lengths."""
    cut = extract_tables(_records(spark, sf_dir, lambda c: c, lambda c: _title(F.col("ctt"))))
    lengths = F.array_join(F.transform("text_list", lambda t: F.length(t).cast("string")), ",")
    return cut.select("page_id", F.md5(F.array_join("text_list", "")).alias("digest"), lengths.alias("lengths"))


def q14_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and its body as two peers, in turns of order: both match, and the longer one is chosen."""
    base = _matched(spark, sf_dir, lambda c: _turn(2, c, header_and_body(c)["body"]), lambda c: _turn(2, header_and_body(c)["body"], c))
    chosen = base.select("page_id", F.size(F.filter("__matches", lambda m: m["matched"])).cast("long").alias("matched"), F.explode(chosen_spans(F.col("__matches"))).alias("s"))
    return chosen.select("page_id", "matched", F.col("s.start").alias("body_start"), F.col("s.end").alias("body_end"), F.col("s.idx").alias("table_idx"))


def q15_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one table that is found, with another that is not, and with none, in turns."""
    none = F.lit(None).cast("string")
    records = extract_tables(_records(spark, sf_dir, lambda c: _turn(3, c, c, none), lambda c: _turn(3, F.lit("@@none@@<br>zzz"), none, none)))
    return summary(records).select("total_records", "total_tables", "matched_tables")


def q16_candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = page_peers(spark, sf_dir).select("page_id", folded_text(F.col("ctt")).alias("s"), folded_text(F.col("content")).alias("q"))
    windows = base.select("page_id", F.posexplode(candidate_windows(F.col("s"), F.col("q"))).alias("seq", "w"))
    return windows.select("page_id", F.col("seq").cast("long"), F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


def q17_doc_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which passage of ``benchmark``, folded; each text is folded and read once."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", folded_text(F.col("text")).alias("s"))
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", folded_text(F.col("text")).alias("q"))
    return passages_in(docs, passages, "doc_id", "s", "item_id", "q")


def _thinned(content):
    """Every 11th character left out."""
    chars = F.filter(F.split(content, ""), lambda c, i: (i + 1) % 11 != 0)
    return F.array_join(chars, "")


def q18_fuzzy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metrics(extract_tables(_records(spark, sf_dir, _thinned)), "page_id")


def q19_loose_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents from a Python literal, from broken text and from nested lists, each content with its form's name in front."""
    quoted = F.regexp_replace("content", r"[\\'\"\n]", " ")
    forms = F.explode(
        F.array(
            F.concat(F.lit("[{'content': 'literal "), quoted, F.lit("', 'n': None}]")),
            F.concat(F.lit('[{"content": "broken '), quoted, F.lit('", bad}]')),
            F.concat(F.lit('[[{"content": "nested '), quoted, F.lit('"}]]')),
        )
    )
    base = page_peers(spark, sf_dir).select("page_id", forms.alias("tabel_info"))
    found = base.select("page_id", F.explode(peer_contents(F.col("tabel_info"), base.schema["tabel_info"].dataType)).alias("content"))
    return found.select("page_id", F.substring_index("content", " ", 1).alias("form"), F.md5("content").alias("digest"))


def q20_legacy_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = page_peers(spark, sf_dir).select("page_id", legacy_folded_text(F.col("ctt")).alias("n"), legacy_body(F.col("content")).alias("body"))
    return base.select("page_id", F.length("n").cast("long").alias("chars"), F.md5("n").alias("digest"), "body")


def _legacy(spark: SparkSession, sf_dir: str, change=lambda c: c) -> DataFrame:
    """The whole content of the navigation as it stands, behind a header line that the text lacks."""
    nav = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    info = F.to_json(F.array(F.struct(F.concat(F.lit("Head<br>"), change(nav)).alias("content"))))
    records = pages.select("page_id", F.col("html").alias("ctt"), info.alias("tabel_info"))
    base = records.select("page_id", "ctt", legacy_bodies(F.col("tabel_info"), records.schema["tabel_info"].dataType).alias("bodies"))
    return with_legacy_segments(base, "ctt", "bodies").select("page_id", "__legacy.*")


def q21_legacy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _legacy(spark, sf_dir)
    return cut.select("page_id", F.length(F.col("segments")[0]).cast("long").alias("start"), F.length(F.col("segments")[1]).cast("long").alias("chars"), F.col("similarities")[0].alias("similarity"))


def q22_legacy_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _legacy(spark, sf_dir).select("page_id", F.posexplode(F.arrays_zip("segments", "types")).alias("seq", "x"))
    return pieces.select("page_id", F.col("seq").cast("long"), F.col("x.types").alias("type"), F.md5("x.segments").alias("digest"))


def q23_legacy_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(spark, sf_dir, _thinned)


def q24_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file written for the query: one record a page, a blank line after every seventh."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tabloom-lines-")
    path = f"{folder}/lines-{uuid.uuid4().hex}"
    ids = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    text = F.concat(F.lit('{"page_id":'), F.col("page_id").cast("string"), F.lit("}"), F.when(F.col("page_id") % 7 == 0, "\n ").otherwise(""))
    # the oracle needs one file in order; the reader itself counts every split on its own
    ids.coalesce(1).sortWithinPartitions("page_id").select(text.alias("value")).write.text(path)
    lines = numbered_lines(spark, path)
    return lines.select(F.get_json_object("value", "$.page_id").cast("long").alias("page_id"), "line_no", "record_index")



def offset_maps(pages: DataFrame) -> DataFrame:
    """(page_id, offsets): where every folded character of ``ctt`` comes from, by prefix sums over its tokens."""
    toks = pages.select("page_id", F.posexplode(tokens(F.col("ctt"))).alias("i", "t"))
    raw = F.sum(F.length("t")).over(Window.partitionBy("page_id").orderBy("i")) - F.length("t")
    runs = toks.select("page_id", "i", token_offsets(F.col("t"), raw).alias("at")).where(F.size("at") > 0)
    return runs.groupBy("page_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "at"))), lambda x: x["at"])).alias("offsets"))


def q25_whole_offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every folded character of every page comes from: how many, their sum and a digest of all, in order."""
    whole = offset_maps(page_peers(spark, sf_dir).select("page_id", "ctt"))
    total = F.aggregate("offsets", F.lit(0).cast("long"), lambda x, y: x + y)
    return whole.select("page_id", F.size("offsets").cast("long").alias("chars"), total.alias("total"), F.md5(F.array_join(F.col("offsets").cast("array<string>"), ",")).alias("digest"))


def q26_inferred_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peer without any break, the visible text of the article: where its body begins is taken from the page's own breaks."""
    article = F.regexp_replace(F.regexp_replace(F.regexp_extract("ctt", r"(?s)<article>(.*?)</article>", 1), r"<[^>]+>", ""), r"[\n\r\\]", " ")
    flat = flat_metrics(extract_tables(page_peers(spark, sf_dir).select("page_id", "ctt", F.array(article).alias("tabel_info"))), "page_id")
    spans = {"full_start": F.col("full_span")[0], "full_end": F.col("full_span")[1], "body_start": F.col("body_span")[0]}
    return flat.select("page_id", "match_mode", "similarity", *[c.alias(n) for n, c in spans.items()], F.length(folded_text(F.col("peer_body"))).cast("long").alias("body_chars"))


def _marked(content):
    """A sign that no page has in front of the last break: one character too many in an otherwise exact copy."""
    return F.regexp_replace(content, r"(?s)^(.*)<br>", "$1¤<br>")


def q27_fuzzy_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noisy copy whose blocks, score and similarity are known in closed form."""
    flat = flat_metrics(extract_tables(_records(spark, sf_dir, _marked)), "page_id")
    spans = {"full_start": F.col("full_span")[0], "full_end": F.col("full_span")[1], "body_start": F.col("body_span")[0]}
    return flat.select("page_id", "matched", "match_mode", "match_score", "similarity", "peer_body", "extracted_table", *[c.alias(n) for n, c in spans.items()])


def _three_lines(html):
    return F.regexp_extract(html, r"(?s)<nav>.*?(<li>.*?</li><li>.*?</li><li>.*?</li>)", 1)


def q28_legacy_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version's sweep for a body of which one character is another: span and similarity in closed form."""
    wrong = F.regexp_replace(_three_lines(F.col("html")), r"(?s)^(.*?</li>)<li>", "$1<¤i>")
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    records = pages.select("page_id", F.col("html").alias("ctt"), F.to_json(F.array(F.struct(F.concat(F.lit("Head<br>"), wrong).alias("content")))).alias("tabel_info"))
    cut = extract_tables(records.select("page_id", "ctt", "tabel_info"), mode="legacy", keep=("page_id",))
    return cut.select("page_id", F.length(F.col("segments")[0]).cast("long").alias("start"), F.md5(F.col("segments")[1]).alias("digest"), F.array_join(F.col("types").cast("array<string>"), "").alias("types"), F.col("similarities")[0].alias("similarity"))


def q29_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of a page, supplied against the order of their places: all pieces."""
    pieces = extract_tables(_records(spark, sf_dir, lambda c: c, lambda c: _title(F.col("ctt")))).select("page_id", F.posexplode(F.arrays_zip("text_list", "type_list")).alias("seq", "x"))
    return pieces.select("page_id", F.col("seq").cast("long"), F.col("x.type_list").alias("type"), F.md5("x.text_list").alias("digest"))


def q30_legacy_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the first version's rules: its spans sorted by place, each with its similarity."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    info = F.to_json(F.array(*[F.struct(F.concat(F.lit("Head<br>"), x).alias("content")) for x in (_three_lines(F.col("html")), _title(F.col("html")))]))
    cut = extract_tables(pages.select("page_id", F.col("html").alias("ctt"), info.alias("tabel_info")), mode="legacy", keep=("page_id",))
    pieces = cut.select("page_id", F.posexplode(F.arrays_zip("segments", "types")).alias("seq", "x"))
    return pieces.select("page_id", F.col("seq").cast("long"), F.col("x.types").alias("type"), F.md5("x.segments").alias("digest"))


_BY_NAME: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    q01_tokenize, q02_normalize_text, q03_offset_map, q04_peer_contents_json, q05_split_header_body, q06_locate_exact, q07_full_span, q08_body_span, q09_extracted_table, q10_flat_metrics_exact, q11_unmatched, q12_segments,
    q13_segments_lossless, q14_overlaps, q15_summary, q16_candidate_windows, q17_doc_passages, q18_fuzzy_metrics, q19_loose_parse, q20_legacy_normalize, q21_legacy_spans, q22_legacy_segments, q23_legacy_fuzzy, q24_line_numbers,
    q25_whole_offset_map, q26_inferred_header, q27_fuzzy_inserted, q28_legacy_replaced, q29_two_tables, q30_legacy_two,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _BY_NAME}

# ---- the same in SQL -------------------------------------------------------------------------------------------------

_BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}]"
_TOKENS = r"(?s)<[^>]+>|&[#a-zA-Z0-9]+;|[^<&\s\p{Z}\p{Cc}\p{Cf}]+|."
_BREAK = r"(?:(?i:<\s*br\s*/?\s*>|</p>\s*<p>)|\\[nr]|[\n\r])+"


def _piece(t: str) -> str:
    return f"""CASE WHEN {t}[1] = '<' AND length({t}) > 1 THEN '' WHEN {t} = '&amp;' THEN '&' WHEN {t} = '&copy;' THEN '©' WHEN {t} = '&middot;' THEN '·' WHEN {t} = '&quot;' THEN '"'
      WHEN {t} = '&lt;' THEN '<' WHEN {t} = '&gt;' THEN '>' WHEN {t} = '&nbsp;' THEN '' WHEN regexp_full_match({t}, '(?s){_BLANK}') THEN '' ELSE lower({t}) END"""


def _folded(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{_TOKENS}'), lambda t: {_piece('t')}), '')"


_PEERS = r"""p AS (SELECT page_id, html AS ctt, regexp_replace(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '</li>\s*<li>', '<br>', 'g') AS content FROM pages)"""
_PLACES = f"""k AS (SELECT page_id, t, i FROM (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(ctt, '{_TOKENS}') AS x FROM p))),
f AS (SELECT page_id, i, t, {_piece("t")} AS f FROM k),
o AS (SELECT page_id, i, length(f) AS size, t[1] = '&' AND length(t) > 1 AS one, sum(length(f)) OVER w - length(f) AS f0, sum(length(t)) OVER w - length(t) AS r0 FROM f WINDOW w AS (PARTITION BY page_id ORDER BY i)),
n AS (SELECT page_id, string_agg(f, '' ORDER BY i) AS norm FROM f GROUP BY page_id)"""
_MAPS = f"""WITH {_PEERS}, {_PLACES},
c AS (SELECT page_id, i, CASE WHEN one THEN list_transform(range(CAST(size AS BIGINT)), lambda x: CAST(r0 AS BIGINT)) ELSE range(CAST(r0 AS BIGINT), CAST(r0 + size AS BIGINT)) END AS l FROM o WHERE size > 0),
w AS (SELECT page_id, flatten(list(l ORDER BY i)) AS a FROM c GROUP BY page_id)
"""
_BODY = rf"""trim(regexp_replace(trim(content, E' \n\r\t'), '(?s)^.*?{_BREAK}', ''), E' \n\r\t')"""
_HEAD = rf"""regexp_extract(trim(content, E' \n\r\t'), '(?s)^(.*?){_BREAK}', 1)"""


def _raw(k: str) -> str:
    return f"(SELECT CAST(o.r0 + CASE WHEN o.one THEN 0 ELSE {k} - o.f0 END AS INTEGER) FROM o WHERE o.page_id = q.page_id AND o.f0 <= {k} AND {k} < o.f0 + o.size)"


_MATCH = f"""WITH {_PEERS}, {_PLACES},
q AS (SELECT p.page_id, ctt, content, norm, {_folded("content")} AS query, {_BODY} AS body, length({_folded(_HEAD)}) AS header, strpos(norm, {_folded("content")}) - 1 AS at FROM p JOIN n USING (page_id)),
m AS (SELECT page_id, ctt, content, body, header, {_raw("q.at")} AS full_start, {_raw("(q.at + length(q.query) - 1)")} + 1 AS full_end, {_raw("(q.at + q.header)")} AS body_start FROM q)
"""
#: The two tables of a page by place: its title first, then its navigation behind the first line.
_TWO = _MATCH + f""", d AS (SELECT page_id, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
x AS (SELECT d.*, {_folded("title")} AS query, strpos(norm, {_folded("title")}) - 1 AS at FROM d JOIN n USING (page_id)),
y AS (SELECT page_id, html, title, {_raw("q.at")} AS s1, {_raw("(q.at + length(q.query) - 1)")} + 1 AS e1 FROM x q),
t AS (SELECT page_id, html, title, s1, e1, m.body_start AS s2, m.full_end AS e2 FROM y JOIN m USING (page_id))
"""
_PAGE_LEGACY = r"""WITH d AS (SELECT page_id, html, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
x AS (SELECT *, regexp_replace(nav, '^[ \n\r\t]+|[ \n\r\t]+$', '', 'g') AS body FROM d),
y AS (SELECT page_id, html, body, strpos(html, body) - 1 AS pos FROM x)
"""

ORACLES: dict[str, str] = {
    "q01_tokenize": f"""WITH {_PEERS}, {_PLACES}
SELECT page_id, count(*) FILTER (t[1] = '<' AND length(t) > 1) AS tag_tokens, count(*) FILTER (t[1] = '&' AND length(t) > 1) AS entity_tokens,
  count(*) FILTER (NOT (t[1] IN ('<', '&') AND length(t) > 1) AND NOT regexp_full_match(t, '(?s){_BLANK}')) AS text_tokens FROM f GROUP BY page_id""",
    "q02_normalize_text": f"WITH {_PEERS} SELECT page_id, CAST(length(n) AS BIGINT) AS chars, md5(n) AS digest FROM (SELECT page_id, {_folded('ctt')} AS n FROM p)",
    "q03_offset_map": _MAPS + "SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST(a[pos + 1] AS BIGINT) AS at FROM (SELECT page_id, a, unnest(range(0, len(a), 100)) AS pos FROM w)",
    "q04_peer_contents_json": f"""WITH {_PEERS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS BIGINT) AS table_idx, md5(content) AS digest
FROM (SELECT page_id, 0 AS k, content FROM p UNION ALL SELECT page_id, 1, 'tail' FROM p) WHERE {_folded("content")} <> ''""",
    "q05_split_header_body": f"WITH {_PEERS} SELECT page_id, {_BODY} AS body, CAST(length({_folded(_HEAD)}) AS BIGINT) AS header_chars FROM p",
    "q06_locate_exact": f"WITH {_PEERS} SELECT page_id, CAST(strpos({_folded('ctt')}, {_folded('content')}) - 1 AS BIGINT) AS at, CAST(length({_folded('content')}) AS BIGINT) AS chars FROM p",
    "q07_full_span": _MATCH + "SELECT page_id, full_start, full_end FROM m",
    "q08_body_span": _MATCH + "SELECT page_id, body_start, full_end AS body_end FROM m",
    "q09_extracted_table": _MATCH + "SELECT page_id, substr(ctt, body_start + 1, full_end - body_start) AS extracted_table FROM m",
    "q10_flat_metrics_exact": _MATCH
    + """SELECT page_id, CAST(0 AS INTEGER) AS table_idx, content AS peer_content, body AS peer_body, true AS matched, substr(ctt, body_start + 1, full_end - body_start) AS extracted_table, 1.0::DOUBLE AS similarity,
  1.0::DOUBLE AS match_score, 'exact' AS match_mode, full_start, full_end, body_start, full_end AS body_end FROM m""",
    "q11_unmatched": _MATCH
    + """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'zzz' ELSE body END AS peer_body, page_id % 2 <> 0 AS matched, CASE WHEN page_id % 2 = 0 THEN '' ELSE substr(ctt, body_start + 1, full_end - body_start) END AS extracted_table,
  CASE WHEN page_id % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity, CASE WHEN page_id % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS match_score, CASE WHEN page_id % 2 = 0 THEN 'unmatched' ELSE 'exact' END AS match_mode, page_id % 2 = 0 AS no_span FROM m""",
    "q12_segments": _MATCH
    + """, s AS (SELECT page_id, 0 AS k, 0 AS type, substr(ctt, 1, body_start) AS t FROM m WHERE body_start > 0
  UNION ALL SELECT page_id, 1, 1, substr(ctt, body_start + 1, full_end - body_start) FROM m
  UNION ALL SELECT page_id, 2, 0, substr(ctt, full_end + 1) FROM m WHERE full_end < length(ctt))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS BIGINT) AS seq, CAST(type AS INTEGER) AS type, md5(t) AS digest FROM s""",
    "q13_segments_lossless": _TWO + """SELECT page_id, md5(html) AS digest, array_to_string(list_filter([s1, e1 - s1, s2 - e1, e2 - s2, length(html) - e2], lambda x, i: x > 0 OR i IN (2, 4)), ',') AS lengths FROM t""",
    "q14_overlaps": _MATCH + "SELECT page_id, CAST(2 AS BIGINT) AS matched, body_start, full_end AS body_end, CAST(page_id % 2 AS INTEGER) AS table_idx FROM m",
    "q15_summary": "SELECT count(*) AS total_records, 2 * count(*) FILTER (page_id % 3 = 0) + count(*) FILTER (page_id % 3 = 1) AS total_tables, count(*) FILTER (page_id % 3 <> 2) AS matched_tables FROM pages",
    "q16_candidate_windows": f"""WITH RECURSIVE {_PEERS},
b AS (SELECT page_id, {_folded("ctt")} AS s, {_folded("content")} AS q FROM p),
a AS (SELECT page_id, s, q, length(q) AS n, least(48, greatest(8, length(q) // 4)) AS size, greatest(32, length(q) // 3) AS pad FROM b WHERE q <> ''),
c AS (SELECT DISTINCT page_id, s, n, pad, begin_, substr(q, begin_ + 1, size) AS anchor FROM (SELECT *, unnest([0, greatest(0, n // 2 - size // 2), greatest(0, n - size)]) AS begin_ FROM a)),
h AS (SELECT page_id, s, n, pad, begin_, anchor, strpos(s, anchor) AS hit, 1 AS k FROM c WHERE strpos(s, anchor) > 0
  UNION ALL SELECT page_id, s, n, pad, begin_, anchor, hit + strpos(substr(s, hit + 1), anchor), k + 1 FROM h WHERE k < 20 AND strpos(substr(s, hit + 1), anchor) > 0),
w AS (SELECT DISTINCT page_id, greatest(0, hit - 1 - begin_ - pad) AS start, least(length(s), hit - 1 - begin_ + n + pad) AS "end" FROM h)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY start, "end") - 1 AS BIGINT) AS seq, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM w""",
    "q17_doc_passages": f"""WITH d AS (SELECT doc_id, {_folded("text")} AS s FROM documents), b AS (SELECT item_id, {_folded("text")} AS q FROM benchmark)
SELECT doc_id, item_id, CAST(strpos(s, q) - 1 AS BIGINT) AS at FROM d JOIN b ON q <> '' AND contains(s, q)""",
    "q19_loose_parse": rf"""WITH {_PEERS} SELECT page_id, form, md5(form || ' ' || regexp_replace(content, '[\\''"\n]', ' ', 'g')) AS digest FROM p, (VALUES ('literal'), ('broken'), ('nested')) v(form)""",
    "q20_legacy_normalize": rf"""WITH {_PEERS}, x AS (SELECT page_id, lower(regexp_replace(regexp_replace(ctt, '[ \n\r\t]', '', 'g'), '(?i)<br\s*/?\s*>', '', 'g')) AS n, regexp_replace(content, '(?is)^.*?<br\s*/?\s*>', '') AS body FROM p)
SELECT page_id, CAST(length(n) AS BIGINT) AS chars, md5(n) AS digest, body FROM x""",
    "q21_legacy_spans": _PAGE_LEGACY + "SELECT page_id, CAST(pos AS BIGINT) AS start, CAST(length(body) AS BIGINT) AS chars, 1.0::DOUBLE AS similarity FROM y",
    "q22_legacy_segments": _PAGE_LEGACY
    + """, s AS (SELECT page_id, 0 AS k, 0 AS type, substr(html, 1, pos) AS t FROM y WHERE pos > 0 UNION ALL SELECT page_id, 1, 1, body FROM y
  UNION ALL SELECT page_id, 2, 0, substr(html, pos + length(body) + 1) FROM y WHERE pos + length(body) < length(html))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS BIGINT) AS seq, CAST(type AS INTEGER) AS type, md5(t) AS digest FROM s""",
    "q24_line_numbers": """SELECT page_id, CAST(r + coalesce(sum(blank) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no, CAST(r - 1 AS BIGINT) AS record_index
FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS blank FROM pages)""",
    "q25_whole_offset_map": _MAPS + """SELECT page_id, CAST(len(a) AS BIGINT) AS chars, CAST(list_sum(a) AS BIGINT) AS total, md5(array_to_string(a, ',')) AS digest FROM w""",
    "q26_inferred_header": f"""WITH {_PEERS}, {_PLACES},
a AS (SELECT page_id, ctt, regexp_replace(regexp_replace(regexp_extract(ctt, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', '', 'g'), '[\\n\\r\\\\]', ' ', 'g') AS content FROM p),
q AS (SELECT page_id, ctt, norm, {_folded("content")} AS query, strpos(norm, {_folded("content")}) - 1 AS at FROM a JOIN n USING (page_id) WHERE {_folded("content")} <> ''),
m AS (SELECT page_id, ctt, query, {_raw("q.at")} AS full_start, {_raw("(q.at + length(q.query) - 1)")} + 1 AS full_end FROM q),
k2 AS (SELECT *, substr(ctt, full_start + 1, full_end - full_start) AS slice FROM m),
c AS (SELECT *, length(regexp_extract(slice, '(?s)^(.*?{_BREAK}\\s*)', 1)) AS cut FROM k2)
SELECT page_id, 'exact' AS match_mode, 1.0::DOUBLE AS similarity, full_start, full_end, CAST(full_start + cut AS INTEGER) AS body_start, CAST(length({_folded("substr(slice, cut + 1)")}) AS BIGINT) AS body_chars FROM c""",
    "q27_fuzzy_inserted": f"""WITH {_PEERS}, {_PLACES},
q AS (SELECT p.page_id, ctt, norm, {_folded("content")} AS query, regexp_replace(content, '(?s)^(.*)<br>', '\\1¤<br>') AS content, strpos(norm, {_folded("content")}) - 1 AS at FROM p JOIN n USING (page_id)),
m AS (SELECT page_id, ctt, length(query) AS size, length({_folded(_HEAD)}) AS header, {_BODY} AS peer_body, {_raw("q.at")} AS full_start, {_raw("(q.at + length(q.query) - 1)")} + 1 AS full_end FROM q)
SELECT page_id, true AS matched, 'fuzzy' AS match_mode, round(size::DOUBLE / (size + 1) * 0.8::DOUBLE + 0.2::DOUBLE, 6) AS match_score, round(2.0::DOUBLE * (size - header) / (size + size + 1 - header), 6) AS similarity,
  peer_body, substr(ctt, full_start + 1, full_end - full_start) AS extracted_table, full_start, full_end, full_start AS body_start FROM m""",
    "q28_legacy_replaced": r"""WITH b AS (SELECT page_id, html, regexp_extract(html, '(?s)<nav>.*?(<li>.*?</li><li>.*?</li><li>.*?</li>)', 1) AS body FROM pages),
m AS (SELECT page_id, html, body, strpos(html, body) - 1 AS pos, length(regexp_replace(body, '[ \n\r\t]', '', 'g')) AS size FROM b)
SELECT page_id, CAST(pos AS BIGINT) AS start, md5(body) AS digest, '010' AS types, (size - 1)::DOUBLE / size AS similarity FROM m""",
    "q29_two_tables": _TWO
    + """, s AS (SELECT page_id, 0 AS k, 0 AS type, substr(html, 1, s1) AS t FROM t UNION ALL SELECT page_id, 1, 1, substr(html, s1 + 1, e1 - s1) FROM t UNION ALL SELECT page_id, 2, 0, substr(html, e1 + 1, s2 - e1) FROM t
  UNION ALL SELECT page_id, 3, 1, substr(html, s2 + 1, e2 - s2) FROM t UNION ALL SELECT page_id, 4, 0, substr(html, e2 + 1) FROM t)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS BIGINT) AS seq, CAST(type AS INTEGER) AS type, md5(t) AS digest FROM s WHERE t <> ''""",
    "q30_legacy_two": r"""WITH b AS (SELECT page_id, html, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), E' \n\r\t') AS one, regexp_extract(html, '(?s)<nav>.*?(<li>.*?</li><li>.*?</li><li>.*?</li>)', 1) AS two FROM pages),
m AS (SELECT page_id, html, one, two, strpos(html, one) - 1 AS s1, strpos(html, two) - 1 AS s2 FROM b),
s AS (SELECT page_id, 0 AS k, 0 AS type, substr(html, 1, s1) AS t FROM m UNION ALL SELECT page_id, 1, 1, one FROM m UNION ALL SELECT page_id, 2, 0, substr(html, s1 + length(one) + 1, s2 - s1 - length(one)) FROM m
  UNION ALL SELECT page_id, 3, 1, two FROM m UNION ALL SELECT page_id, 4, 0, substr(html, s2 + length(two) + 1) FROM m)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS BIGINT) AS seq, CAST(type AS INTEGER) AS type, md5(t) AS digest FROM s WHERE t <> ''""",
}
