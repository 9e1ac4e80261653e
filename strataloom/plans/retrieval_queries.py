"""Queries of the retrieval: question analysis, BM25, graph seeds, ranking, budget, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refdata, text
from ..operators import retrieval
from ..operators.lineage import cut
from . import engine
from .graph_queries import _G, tables


def _questions(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _passages(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/extracted_pages.parquet").select("document_id", "page_number", "text").dropDuplicates()
    return p.select(F.concat("document_id", F.lit("_p"), "page_number").alias("pid"), "text")


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    q = _questions(s, d).select("qid", "query", text.keywords("query").alias("terms"))
    return retrieval.bm25(_passages(s, d), q, 10)


def bm25_expanded(s: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_passages(s, d), retrieval.terms_of(_questions(s, d)), 10)


def scoped_bm25(s: SparkSession, d: str) -> DataFrame:
    """The best code passages of each repository for each question, by the repository's own statistics."""
    q = _questions(s, d).select("qid", "query", text.keywords("query").alias("terms"))
    return retrieval.bm25(engine.code_passages(tables(s, d)[0]).where("repository_name is not null"), q, 3, scope="repository_name")


def _candidates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = cut(retrieval.terms_of(_questions(s, d)), "asked")
    vs, es = tables(s, d)
    return retrieval.graph_candidates(vs, es, retrieval.asked_graph(asked), 16, 32), asked


def graph_retrieve(s: SparkSession, d: str) -> DataFrame:
    """What the graph holds on each question: seeds and the edges at them."""
    return _candidates(s, d)[0].select("qid", "item_id", "type", "title", "graph_score", "provenance_score")


def _ranked(s: SparkSession, d: str) -> DataFrame:
    items, asked = _candidates(s, d)
    return retrieval.rank(items.join(asked.select("qid", "intent", "entities", "targets"), "qid"), F.col("intent"), F.col("entities"), F.col("targets"))


def context_query(s: SparkSession, d: str) -> DataFrame:
    """All questions through the engine: graph and passages, ranked together."""
    vs, es = tables(s, d)
    pages = _passages(s, d).select(F.concat(F.lit("chunk:"), "pid").alias("pid"), "text", F.regexp_extract("pid", r"^(.*)_p-?\d+$", 1).alias("document_id"), F.regexp_extract("pid", r"_p(-?\d+)$", 1).cast("int").alias("page_number"))
    pages = pages.where("text is not null and pid is not null").dropDuplicates(["pid", "text"]).groupBy("pid", "document_id", "page_number").agg(F.min("text").alias("text")).withColumn("origin", F.col("document_id"))
    return engine.ContextEngine(vs, es, pages).answer_all(_questions(s, d)).select("qid", "rank", "item_id", "type", "score")


def token_budget(s: SparkSession, d: str) -> DataFrame:
    """The pages of each document in order, as far as 600 tokens go."""
    p = s.read.parquet(f"{d}/extracted_pages.parquet").where("text is not null and document_id is not null").groupBy("document_id", "page_number").agg(F.min("text").alias("content"))
    b = retrieval.within_budget(p, 600, ["document_id"], "page_number")
    return b.select("document_id", "page_number", "tokens", "used", "taken", F.length("shown").alias("shown_chars"))


def keep_first(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/extracted_pages.parquet").where("text is not null").groupBy("document_id", "page_number").agg(F.min("text").alias("content"))
    one = p.select("document_id", F.col("page_number").alias("rank"), F.col("page_number").cast("string").alias("item_id"), "content")
    return retrieval.keep_first(one, ["document_id"]).select("document_id", F.size("kept").alias("n_kept"))


def vectors(s: SparkSession, d: str) -> DataFrame:
    v = s.read.parquet(f"{d}/embeddings.parquet")
    return retrieval.vector_top_k(v, v.where("vec_id % 20 = 0"), 5).select("query_id", "id", "similarity")


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_expanded": bm25_expanded,
    "intents": lambda s, d: _questions(s, d).select("qid", text.intent("query").alias("intent")),
    "keywords": lambda s, d: _questions(s, d).select("qid", F.array_join(text.keywords("query"), " ").alias("keywords")),
    "search_terms": lambda s, d: _questions(s, d).select("qid", F.array_join(text.expand_terms(text.keywords("query")), " ").alias("terms")),
    "question_entities": lambda s, d: _questions(s, d).select("qid", F.array_join(text.question_entities("query"), "|").alias("entities"), F.array_join(text.question_targets("query"), "|").alias("targets")),
    "scoped_bm25": scoped_bm25,
    "context_query": context_query,
    "graph_terms": lambda s, d: retrieval.asked_graph(retrieval.terms_of(_questions(s, d))),
    "rank_items": lambda s, d: _ranked(s, d).select("qid", "item_id", "score"),
    "rank_topk": lambda s, d: retrieval.top_k(_ranked(s, d), 8, ["qid"]).select("qid", "rank", "item_id", "score"),
    "graph_retrieve": graph_retrieve,
    "token_budget": token_budget,
    "keep_first": keep_first,
    "vector_topk": vectors,
}

_STOP = "[" + ", ".join(f"'{w}'" for w in refdata.STOPWORDS) + "]"
_KW = lambda c: rf"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-zA-Z0-9_\- \t\n\r\f\v]', ' ', 'g'), '[ \t\n\r\f\v]+'), lambda x: length(x) >= 2 and not list_contains({_STOP}, x))"
_ROOTS = "case when w like '%ies' and length(w) > 4 then [w[:-4] || 'y'] when w like '%es' and length(w) > 4 then [w[:-3]] when w like '%s' and length(w) > 3 then [w[:-2]] when w like '%ified' and length(w) > 4 then [w[:-3], w[:-6] || 'ify'] when w like '%ed' and length(w) > 4 then [w[:-3]] when w like '%ing' and length(w) > 4 then [w[:-4]] when w like '%tion' and length(w) > 5 and contains(w, 'auth') then ['auth'] when w like '%tion' and length(w) > 5 and contains(w, 'verif') then ['verify', 'verification'] else [] end"
_TERMS = f"""
k as (select item_id as qid, w, i from (select item_id, unnest(ks) as w, unnest(range(len(ks))) as i from (select item_id, {_KW('text')} as ks from benchmark)) qualify row_number() over (partition by item_id, w order by i) = 1)"""


# The intents' words as the SQL has them: * for any ending, + for an optional s, ~ for an optional hyphen, underscore or blank.
_INTENT_WORDS = {
    "authentication": "auth* login jwt token+ bearer password+ permission+ role+ credential+ oauth session+ api~key+ verif*",
    "api_routes": "api+ route+ endpoint+ rest http get post put delete patch handler+ fastapi router+ controller+ request+ response+",
    "dependency": "depend* import+ require* package+ librar* module+ inherit* extend+ subclass* caller+ callee+",
    "data_flow": "flow data~flow pipeline+ process* etl ingest* lifecycle stream* transform* step+ stage+",
    "schema": "schema+ table+ column+ sheet+ workbook+ field+ entity entities relationship+ vertex vertices edge+ graph+ age cypher model+ database+ postgres* sql connect*",
    "architecture": "architect* structure+ overview high~level component+ design system+ layer+ lakehouse framework+ stack+",
}
_INTENT_MORE = {
    "authentication": "auth token jwt bearer login credential verify", "dependency": "dependency dependencies import library package depends_on imports requirements", "api_routes": "route endpoint api router http get post",
    "schema": "schema table column sheet model database field", "data_flow": "pipeline flow etl ingest process lakehouse",
}


def _intent_sql() -> str:
    one = lambda w: "len(regexp_extract_all(lower(text), '\\b" + w.replace("*", "\\w*").replace("+", "s?").replace("~", "[-_ ]?") + "\\b'))"
    counts = ", ".join(f"{' + '.join(map(one, ws.split()))} as n{i}" for i, ws in enumerate(_INTENT_WORDS.values()))
    top = f"greatest({', '.join(f'n{i}' for i in range(6))})"
    return f"select item_id as qid, case when {top} = 0 then 'general' " + " ".join(f"when n{i} = {top} then '{n}'" for i, n in enumerate(_INTENT_WORDS)) + f" end as intent from (select item_id, {counts} from benchmark)"


def _all_sql(group: int, pattern: str, part: int = 0, change: str = "x") -> str:
    p = pattern.replace("'", "''")
    return f"select qid, {group} as g, i, {change} as e from (select qid, unnest(l) as x, unnest(range(len(l))) as i from (select item_id as qid, regexp_extract_all(text, '{p}', {part}) as l from benchmark))"


_STOPPED = f"list_contains({_STOP}, lower(e))"
_ASK = f"""
ent_raw as (select * from ({_all_sql(1, '["' + "']([^\"']+)[\"']", 1, "trim(x, ' ')")}) where e <> '' union all select * from ({_all_sql(2, "\\b[A-Z][a-zA-Z0-9]+(?:[A-Z][a-zA-Z0-9]+)+\\b")}) where length(e) > 3 union all {_all_sql(3, "\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b")}
  union all select * from ({_all_sql(4, "\\b[A-Z]{2,6}\\b")}) where not {_STOPPED}),
ent as (select qid, e, min((g, i)) as o from ent_raw group by 1, 2),
tgt_raw as ({_all_sql(1, "(?i)\\b[\\w\\-/\\\\]+\\.(?:py|js|json|md|pdf|xlsx|xls|csv|tsv|parquet|html|xml|yaml|yml)\\b")} union all select * from ({_all_sql(2, "\\b[a-zA-Z_][a-zA-Z0-9_]{2,}\\(\\)", 0, "regexp_replace(x, '[()]+$', '')")} union all {_all_sql(3, "\\b[a-z]+(?:_[a-z0-9]+)+\\b")}) where not {_STOPPED}),
tgt as (select qid, e, min((g, i)) as o from tgt_raw group by 1, 2),
intent as ({_intent_sql()})"""
_ROOTS_WIDE = "case when w like '%ies' and length(w) > 4 then [w[:-4] || 'y'] when w like '%es' and length(w) > 4 then [w[:-3]] when w like '%s' and length(w) > 3 then [w[:-2]] when w like '%ified' then [w[:-3], w[:-2], w[:-6] || 'ify'] when w like '%ed' and length(w) > 4 then [w[:-3], w[:-2]] when w like '%ing' and length(w) > 4 then [w[:-4], w[:-4] || 'e'] when w like '%tion' and length(w) > 5 then list_concat(case when contains(w, 'auth') then ['auth'] else [] end, case when contains(w, 'verif') then ['verify', 'verification'] else [] end) else [] end"
_B = r"[ \t\n\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BARE = lambda x: f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"
_GRAPH_TERMS = f"""
said as (select distinct qid, {_BARE('e')} as w from (select qid, e from ent union all select qid, e from tgt union all select qid, w from k)),
low as (select distinct qid, lower(w) as w from said where length(w) >= 2),
token as (select distinct qid, token from (select qid, w as token from said union all select qid, w from low union all select qid, unnest({_ROOTS_WIDE}) from low union all select qid, unnest(string_split(more, ' ')) from intent join (values {", ".join(f"('{k}', '{v}')" for k, v in _INTENT_MORE.items())}) as m(intent, more) using (intent)) where length(token) >= 2)"""
#: Terms of a question for passages: keywords, entities and the words of entities and targets, with their simpler forms.
_EXPANDED = f"""
base as (select distinct qid, w from (select qid, w from k union all select qid, lower(e) from ent where length(e) >= 2 union all select qid, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(e), '[^a-zA-Z0-9_\\-.]', ' ', 'g'), ' +'), lambda x: length(x) > 1)) from (select qid, e from ent union all select qid, e from tgt))),
asked as (select distinct qid, w from (select qid, w from base union all select qid, unnest({_ROOTS}) from base))"""


def _bm25_sql(name: str, passages: str, asked: str, limit: int, scope: str = "") -> str:
    """CTEs up to ``name`` (scope, qid, pid, raw, score, rank): passages (scope, pid, text) and asked (qid, w) are CTEs."""
    c = f"{scope}, " if scope else ""
    using = f"using ({scope})" if scope else "on true"
    n = name
    return f"""
{n}_t as (select {c}pid, text, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-zA-Z0-9_\\-.]', ' ', 'g'), ' +'), lambda w: length(w) > 1) as ts from {passages}),
{n}_st as (select {c}count(*) as n, avg(len(ts)) as avgdl from {n}_t {'group by 1' if scope else ''}),
{n}_tf as (select {c}pid, dl, term, count(*) as tf from (select {c}pid, len(ts) as dl, unnest(ts) as term from {n}_t) where term in (select w from {asked}) group by all),
{n}_df as (select {c}term, count(*) as df from {n}_tf group by all),
{n}_h as (select {c}a.qid, pid, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as raw, count(*) as found from {n}_tf join {n}_df using ({c}term) join {n}_st {using} join {asked} a on a.w = term group by all),
{n}_nq as (select qid, count(*) as n_terms from {asked} group by 1),
{n}_b as (select {c}qid, pid, round(raw + case when found = n_terms and contains(lower(t.text), lower(q.text)) then 3.0 else 0 end, 9) as raw from {n}_h join {n}_nq using (qid) join {n}_t t using ({c}pid) join benchmark q on q.item_id = qid),
{n} as (select {c}qid, pid, round(raw / max(raw) over (partition by {c}qid), 4) as score, rank from (select *, (row_number() over (partition by {c}qid order by raw desc, pid))::int as rank from {n}_b where raw > 0) where rank <= {limit})"""


_SEARCHED = "concat_ws(chr(10), " + ", ".join(f"coalesce({c}, '')" for c in ("name", "id", "description", "file_path", "source_snippet", "aliases", "label")) + ")"
#: Candidates of the graph: 16 vertices a token, edges at the first 20 seeds, 32 of them; edges that speak of a token where no vertex does.
_CAND = f"""
want as (select qid, token, {_BARE("lower(regexp_replace(token, '[''\"\\\\]', '', 'g'))")} as low from token),
ws as (select id, unnest(list_distinct(regexp_split_to_array(lower({_SEARCHED}), '\\W+'))) as low from v),
hit as (select low, id from ws where low in (select low from want where length(low) >= 2 and regexp_full_match(low, '\\w+')) union all select low, id from v join (select distinct low from want where length(low) >= 2 and not regexp_full_match(low, '\\w+')) on regexp_matches(lower({_SEARCHED}), regexp_replace(low, '[^\\w-]', '.', 'g'))),
top as (select low, id from hit qualify row_number() over (partition by low order by id) <= 16),
seed as (select distinct qid, id from top join want using (low)),
first as (select qid, id from seed qualify row_number() over (partition by qid order by id) <= 20),
link as (select qid, src, label, dst, 0.85 as g from (select distinct f.qid, src, label, dst from e join first f on f.id = src or f.id = dst) qualify row_number() over (partition by qid order by src, label, dst) <= 32),
lone as (select distinct qid, lower(token) as low from want where qid not in (select qid from seed)),
said_e as (select distinct qid, src, label, dst from (select src, label, dst, unnest(list_distinct(regexp_split_to_array(lower(concat_ws(chr(10), label, description)), '\\W+'))) as low from e) join lone using (low)),
more as (select *, 0.9 as g from said_e qualify row_number() over (partition by qid order by src, label, dst) <= 25),
cand as (
  select qid, 'code:node:' || id as item_id, 'entity' as type, label || ': ' || name as title, concat_ws(' ', name, description, file_path) as content, 1.0::double as g, 0.0::double as s, case when coalesce(file_path, '') <> '' then 1.0 else 0.5 end::double as p, start_line, null::int as page_number, coalesce(commit_sha, '') as origin from seed join v using (id)
  union all select qid, concat_ws('|', 'code:edge', e.src, e.label, e.dst), 'relationship', concat_ws(' ', a.name, e.label, b.name), concat_ws(' ', a.name, lower(e.label), b.name, e.description), l.g::double, 0.0, case when coalesce(e.file_path, '') <> '' then 0.9 else 0.4 end, e.start_line, null, coalesce(e.commit_sha, '')
  from (select * from link union all select * from more) l join e on e.src = l.src and e.label = l.label and e.dst = l.dst join v a on e.src = a.id join v b on e.dst = b.id)"""
_HAS = lambda c, ws: "(" + " or ".join(f"contains({c}, '{w}')" for w in ws.split()) + ")"
_NAMES = "list_sum(list_transform(names, lambda x: case when contains(lower(title), lower(x)) then 0.15 when contains(lower(content), lower(x)) then 0.08 else 0.0 end))"


def _rank_sql(pool: str) -> str:
    """CTE ``scored``: the pool's candidates with their scores."""
    t, c = "lower(title)", "lower(content)"
    boost = (
        f"case when intent = 'api_routes' and ({_HAS(t, 'route endpoint')} or {_HAS(c, 'fastapi router')}) then 0.20 when intent = 'authentication' and {_HAS(c, 'jwt auth token password bearer')} then 0.20 when intent = 'dependency' and type = 'relationship' and {_HAS(c, 'imports depends_on extends')} then 0.25 "
        f"when intent = 'schema' and {_HAS(c, 'column table sheet field schema datatype')} then 0.20 when intent = 'data_flow' and (type = 'relationship' or {_HAS(c, 'pipeline flow')}) then 0.15 when intent = 'architecture' and type in ('subgraph', 'entity') then 0.10 else 0.0 end"
    )
    rel = "case when g > 0 and s > 0 then (0.5 * g + 0.3 * s) / 0.8 * 1.15 when g > 0 then g when s > 0 then s else 0.0 end"
    place = "(case when start_line > 0 then 0.08 else 0.0 end) + (case when page_number > 0 then 0.08 else 0.0 end) + (case when coalesce(origin, '') <> '' then 0.04 else 0.0 end)"
    names = "named as (select qid, list(e) as names from (select qid, e from ent union all select qid, e from tgt) group by 1)"
    return f"{names}, scored as (select c.*, round((0.8::double * ({rel})::double + 0.2::double * p) * (1.0::double + ({boost})::double + least(coalesce(({_NAMES})::double, 0.0), 0.30::double) + ({place})::double), 4) as score from {pool} c join intent using (qid) left join named using (qid))"


ORACLE = {
    "intents": _intent_sql(),
    "keywords": f"with {_TERMS} select b.item_id as qid, coalesce(string_agg(w, ' ' order by i), '') as keywords from benchmark b left join k on b.item_id = k.qid group by 1",
    "search_terms": f"with {_TERMS}, r as (select qid, unnest({_ROOTS}) as w, i, 1 as z from k), rr as (select qid, w, 1 as z, i, 0 as j from r), a as (select qid, w, 0 as z, i from k union all select qid, w, 1, i from r), o as (select qid, w, min((z, i)) as zi from a group by 1, 2) select b.item_id as qid, coalesce(string_agg(w, ' ' order by zi), '') as terms from benchmark b left join o on b.item_id = o.qid group by 1",
    "bm25_topk": f"with psg as (select document_id || '_p' || page_number as pid, text from (select distinct document_id, page_number, text from extracted_pages)), {_TERMS}, asked as (select qid, w from k), {_bm25_sql('r', 'psg', 'asked', 10)} select qid, pid, score, rank from r",
    "bm25_expanded": f"with psg as (select document_id || '_p' || page_number as pid, text from (select distinct document_id, page_number, text from extracted_pages)), {_TERMS}, {_ASK}, {_EXPANDED}, {_bm25_sql('r', 'psg', 'asked', 10)} select qid, pid, score, rank from r",
    "scoped_bm25": _G + f""", psg as (select 'code:' || id as pid, trim(concat_ws(' ', name, file_path, description, source_snippet)) as text, repository_name from v where repository_name is not null and (coalesce(source_snippet, '') not in ('', '""') or coalesce(description, '') not in ('', '""'))), {_TERMS}, asked as (select qid, w from k), {_bm25_sql('r', 'psg', 'asked', 3, 'repository_name')} select repository_name, qid, pid, score, rank from r""",
    "question_entities": f"with {_TERMS[1:]}, {_ASK}, a as (select qid, string_agg(e, '|' order by o) as entities from ent group by 1), b as (select qid, string_agg(e, '|' order by o) as targets from tgt group by 1) select item_id as qid, coalesce(entities, '') as entities, coalesce(targets, '') as targets from benchmark left join a on a.qid = item_id left join b on b.qid = item_id",
    "graph_terms": f"with {_TERMS[1:]}, {_ASK}, {_GRAPH_TERMS} select qid, token from token",
    "graph_retrieve": _G + f",{_TERMS}, {_ASK}, {_GRAPH_TERMS}, {_CAND} select qid, item_id, type, title, g as graph_score, p as provenance_score from cand",
    "rank_items": _G + f",{_TERMS}, {_ASK}, {_GRAPH_TERMS}, {_CAND}, {_rank_sql('cand')} select qid, item_id, score from scored",
    "rank_topk": _G + f",{_TERMS}, {_ASK}, {_GRAPH_TERMS}, {_CAND}, {_rank_sql('cand')} select qid, rank, item_id, score from (select *, (row_number() over (partition by qid order by score desc, item_id))::int as rank from scored) where rank <= 8",
    "context_query": _G + f""",{_TERMS}, {_ASK}, {_GRAPH_TERMS}, {_CAND}, {_EXPANDED}, psg as (select 'chunk:' || document_id || '_p' || page_number as pid, document_id, page_number, min(text) as text from extracted_pages where text is not null and document_id is not null group by 1, 2, 3), {_bm25_sql('r', 'psg', 'asked', 16)},
pool as (select * from cand union all select qid, pid, 'chunk', pid, text, 0.0, score, 1.0, null, page_number, document_id from r join psg using (pid)), {_rank_sql('pool')},
once as (select *, md5(lower({_BARE('content')})) as said from scored qualify row_number() over (partition by qid, item_id order by score desc, md5(lower({_BARE('content')})) desc) = 1), kept as (select * from once qualify row_number() over (partition by qid, said order by score desc, item_id) = 1)
select qid, rank, item_id, type, score from (select *, (row_number() over (partition by qid order by score desc, item_id))::int as rank from kept) where rank <= 8""",
    "keep_first": f"with p as (select document_id, page_number, min(text) as content from extracted_pages where text is not null group by 1, 2) select document_id, count(distinct md5(lower({_BARE('content')})))::int as n_kept from p where page_number is not null group by 1",
    "token_budget": """
with p as (select document_id, page_number, min(text) as content from extracted_pages where text is not null and document_id is not null group by 1, 2),
t as (select *, (case when length(content) = 0 then 0 else greatest(1, length(content) // 4) end)::int as tokens from p),
u as (select *, (sum(tokens) over (partition by document_id order by page_number rows unbounded preceding))::bigint as used from t),
o as (select *, coalesce(max((used > 600)::int) over (partition by document_id order by page_number rows between unbounded preceding and 1 preceding), 0) as over_ from u),
f as (select *, over_ = 0 and used <= 600 as fits, over_ = 0 and used > 600 and 600 - (used - tokens) > 80 as cut from o)
select document_id, page_number, tokens, used, fits or cut as taken, (case when fits then length(content) when cut then least(length(content), (600 - (used - tokens)) * 4) end)::int as shown_chars from f""",
    "vector_topk": "with s as (select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select query_id, id, similarity from s qualify row_number() over (partition by query_id order by similarity desc, id) <= 5",
}
