"""Queries over texts, addresses and bytes: hashes, keys, line ends, cleansing, screening, front matter, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaica import dims, errors
from mosaica.functions import screening, text, urls
from mosaica.operators import convert, maps
from mosaica.plans.registry import decorated, query, sql, table
from mosaica.sources import folders

_IN = "(" + ", ".join(f"'{r.value}'" for r in dims.CORE.rules if r.match == "exact") + ")"
_CLAIMED = f"(x_name in {_IN} or " + " or ".join(f"starts_with(x_name, '{r.value}')" for r in dims.CORE.rules if r.match == "prefix") + ")"
_RULES = "(values " + ", ".join(f"('{r.id}', '{r.kind}', '{r.match}', '{r.value}')" for r in dims.CORE.rules) + ") r(id, kind, match, value)"
_QUERY = """
    spans as (select page_id, url, strpos(url, '?') - 1 as s, case when strpos(url, '?') = 0 then null when strpos(substr(url, strpos(url, '?')), '#') > 0
      then strpos(url, '?') + strpos(substr(url, strpos(url, '?')), '#') - 2 else length(url) end as e from pages),
    parts as (select page_id, url, s, e, string_split(substr(url, s + 2, e - s - 1), '&') as ps from spans where s >= 0),
    each as (select page_id, s, i, p, x_name, s + 1 + coalesce(list_sum(list_transform(ps[1:i - 1], lambda q: length(q) + 1)), 0) as pos
      from (select *, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as i, split_part(unnest(ps), '=', 1) as x_name from parts))"""
_STRUCK = f"""
    claims as (select each.*, id, kind, row_number() over (partition by page_id, i order by case match when 'exact' then 0 else 1 end, -length(value), id) as k
      from each join {_RULES} on (match = 'exact' and x_name = value) or (match = 'prefix' and starts_with(x_name, value)))"""


@query("select doc_id, 'sha256:' || sha256(text) as hash from documents")
def content_hash(spark, sf_dir):
    """Hash of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("""select doc_id, v as variant, regexp_full_match(case v when 0 then h when 1 then upper(h) when 2 then h[1:70] else h[8:] end, 'sha256:[0-9a-f]{64}') as ok
          from (select doc_id, 'sha256:' || sha256(text) as h from documents), (values (0), (1), (2), (3)) t(v)""")
def hash_shape(spark, sf_dir):
    """Which spellings of a hash are one."""
    h = text.content_hash(F.col("text"))
    variants = F.array(h, F.upper(h), F.substring(h, 1, 70), F.substring(h, 8, 100))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(variants).alias("variant", "h")).select("doc_id", "variant", text.is_hash(F.col("h")).alias("ok"))


@query("""with p as (select page_id, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') as parts from pages)
          select page_id, case when list_contains(parts, '') then null else array_to_string(parts, '/') end as unit_key, case when list_contains(parts, '') then 'empty_part' end as refusal from p""")
def unit_keys(spark, sf_dir):
    """Keys of addresses, refusals named."""
    parts = F.split(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/")
    return table(spark, sf_dir, "pages").select("page_id", text.unit_key(parts).alias("unit_key"), text.key_refusal(parts).alias("refusal"))


@query("""select conv_id, cast(count(*) as bigint) as turns, min(unit_key) as first_key, sha256(string_agg(sha256(text), '' order by turn)) as digest
          from (select *, conv_id || '/' || turn as unit_key from conversations) group by conv_id""")
def conversation_units(spark, sf_dir):
    """Turns grouped by unit, in the order of their key parts."""
    key = text.unit_key(F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("unit_key"), F.sha2("text", 256).alias("h"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("unit_key").alias("first_key"), F.sort_array(F.collect_list(F.struct("turn", "h"))).alias("t")).select("conv_id", "turns", "first_key", F.sha2(F.array_join("t.h", ""), 256).alias("digest"))


@query("select doc_id, length(text)::bigint as n_chars, sha256(text) as hash from documents")
def normalize_endings(spark, sf_dir):
    """CRLF and CR made LF give the original back."""
    t = text.normalized(F.col("text"))
    return decorated(spark, sf_dir, "crlf").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("hash"))


@query(f"with {_QUERY} select page_id, s::bigint as \"start\", e::bigint as \"end\" from spans where s >= 0")
def url_query_span(spark, sf_dir):
    """Where the query of an address is."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.query_span(F.col("url")).alias("q")).where("q is not null")
    return rows.select("page_id", F.col("q.start").cast("long").alias("start"), F.col("q.end").cast("long").alias("end"))


@query(f"""with {_QUERY}, kept as (select page_id, string_agg(p, '&' order by i) as q from each where x_name = '' or not {_CLAIMED} group by page_id)
           select spans.page_id, case when s < 0 then spans.url else substr(spans.url, 1, s) || coalesce('?' || q, '') || substr(spans.url, e + 1) end as url from spans left join kept using (page_id)""")
def url_cleanse(spark, sf_dir):
    """Addresses without tracking parameters."""
    return table(spark, sf_dir, "pages").select("page_id", urls.cleansed(F.col("url")).alias("url"))


@query(f"""with {_QUERY}, {_STRUCK} select page_id, id as rule, kind, pos::bigint as "start", (pos + length(p))::bigint as "end", length(p)::bigint as characters, 'sha256:' || sha256(p) as hash from claims where k = 1""")
def url_removals(spark, sf_dir):
    """A record of every parameter taken."""
    found = urls.removals(table(spark, sf_dir, "pages"), ["page_id"], "url")
    return found.select("page_id", "rule", "kind", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "characters")), "hash")


@query(f"with {_QUERY}, {_STRUCK} select id as rule, kind, count(*) as n from claims where k = 1 group by id, kind")
def removals_by_rule(spark, sf_dir):
    """A4: how often each rule fired."""
    return urls.removals(table(spark, sf_dir, "pages"), ["page_id"], "url").groupBy("rule", "kind").agg(F.count("*").alias("n"))


@query("select page_id, url from pages")
def url_cleanse_none(spark, sf_dir):
    """The empty pack takes nothing."""
    return table(spark, sf_dir, "pages").select("page_id", urls.cleansed(F.col("url"), dims.NONE).alias("url"))


_NAMES = "case doc_id % 7 when 0 then 'utm_c' || cast(doc_id as string) when 1 then 'utm' when 2 then 'id' when 3 then 'ref_' when 4 then 'mtm_' || cast(doc_id as string) when 5 then 'fbclid' else 'refx' end"
_PACK = (dims.Rule("a", "k", "exact", "utm"), dims.Rule("b", "k", "prefix", "utm_"), dims.Rule("c", "k", "prefix", "utm_c"), dims.Rule("d", "k", "prefix", "utm_c"), dims.Rule("e", "k", "prefix", "ref"), dims.Rule("f", "k", "exact", "ref_"), dims.Rule("g", "k", "prefix", "u"))


@query(f"""with n as (select doc_id, {_NAMES} as name from documents), r(id, match, value) as (values {", ".join(f"('{r.id}', '{r.match}', '{r.value}')" for r in _PACK)})
           select doc_id, name, (select id from r where (match = 'exact' and name = value) or (match = 'prefix' and starts_with(name, value)) order by match <> 'exact', -length(value), id limit 1) as rule from n""")
def rule_precedence(spark, sf_dir):
    """Of overlapping rules the exact, the longer, the first by id; as a broadcast join with a top-1 window."""
    names = spark.sql(f"select doc_id, {_NAMES} as name from {{documents}}", documents=table(spark, sf_dir, "documents"))
    return urls.claims(names, dims.rules(spark, dims.Ruleset("own", "1", _PACK))).select("doc_id", "name", "rule")


@query("select unnest(['referral_marketing', 'tracking_parameter']) as kind, unnest([3, 62])::bigint as rules")
def ruleset_kinds(spark, sf_dir):
    """Kinds of the core pack."""
    return dims.rules(spark).groupBy("kind").agg(F.count("*").alias("rules"))


@query("select doc_id, (length(text) + 5)::bigint as \"start\", (length(text) + 5 + length('https://e.test/p/' || doc_id || '?utm_source=a&id=' || doc_id || '&ref=z'))::bigint as \"end\" from documents")
def find_urls(spark, sf_dir):
    """Addresses in texts, without the full stop after them."""
    rows = decorated(spark, sf_dir, "linked").select("doc_id", F.explode(urls.urls(F.col("text"))).alias("u"))
    return rows.select("doc_id", F.col("u.start").cast("long").alias("start"), F.col("u.end").cast("long").alias("end"))


@query("select doc_id, sha256(text || ' see https://e.test/p/' || doc_id || '?id=' || doc_id || '.') as hash, 2::bigint as removals, ['tracking.utm-family', 'referral.ref'] as rules from documents")
def text_cleanse(spark, sf_dir):
    """Texts without tracking parameters, and which rules took them."""
    rows = decorated(spark, sf_dir, "linked").select("doc_id", urls.cleansing(F.col("text")).alias("c"))
    return rows.select("doc_id", F.sha2("c.text", 256).alias("hash"), F.size("c.removals").cast("long").alias("removals"), F.col("c.removals.rule").alias("rules"))


@query("""with p as (select doc_id, length(text) as n, length(text || ' see https://e.test/p/' || doc_id) as m, length(cast(doc_id as varchar)) as d from documents),
            s as (select doc_id, 0 as seq, 0 as o1, m as o2, 0 as s1, m as s2, 'verbatim' as kind, null as rule from p
              union all select doc_id, 1, m, m + 4 + d, m, m + 23 + d, 'transformed', 'url_query' from p union all select doc_id, 2, m + 4 + d, m + 5 + d, m + 23 + d, m + 24 + d, 'verbatim', null from p)
          select doc_id, seq, o1 as out_start, o2 as out_end, s1 as src_start, s2 as src_end, kind, rule from s""")
def cleanse_segments(spark, sf_dir):
    """The map of the cleansing."""
    rows = decorated(spark, sf_dir, "linked").select("doc_id", urls.cleansing(F.col("text"))["segments"].alias("segments"))
    out = maps.exploded(rows, ["doc_id"])
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("seq", "out_start", "out_end", "src_start", "src_end")), "kind", "rule")


_KEYS = """(select doc_id, case doc_id % 7 when 0 then 'github.pat-classic' else 'aws.access-key' end as rule, length(text) + 1 as a, length(text) + case doc_id % 7 when 0 then 41 else 21 end as b,
    case doc_id % 7 when 0 then 'gh' || 'p_' || repeat('a', 36) else 'AK' || 'IA' || repeat('Z', 16) end as v from documents where doc_id % 7 in (0, 3))"""


@query(f"select doc_id, rule, a::bigint as \"start\", b::bigint as \"end\", (b - a)::bigint as characters, 'sha256:' || sha256(v) as hash from {_KEYS}")
def signature_findings(spark, sf_dir):
    """K1 to K3: known formats, not when glued to a longer run nor when too short."""
    found = screening.findings(decorated(spark, sf_dir, "keyed"), ["doc_id"], "text")
    return found.select("doc_id", "rule", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "characters")), "hash")


@query(f"select doc_id, rule from {_KEYS} where not (rule = 'github.pat-classic' and doc_id % 2 = 0)")
def screen_gate(spark, sf_dir):
    """Findings that aren't on the allow-list stop a run."""
    found = screening.findings(decorated(spark, sf_dir, "keyed"), ["doc_id"], "text")
    allowed = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.lit("github.pat-classic").alias("rule"), "doc_id")
    return screening.gate(found, allowed, "doc_id").select("doc_id", "rule")


@query(r"""with runs as (select doc_id, 'entropy.hex' as rule, unnest(regexp_extract_all(text, '[0-9a-fA-F]{20,}')) as v, 3.0 as least from documents
             union all select doc_id, 'entropy.base64', unnest(regexp_extract_all(text, '[0-9A-Za-z_\-]{20,}')), 4.5 from documents),
             one as (select doc_id, rule, v, least, count(*) as n from runs group by all),
             bits as (select doc_id, rule, v, least, n, -list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)))) as h from one)
           select doc_id, rule, length(v)::bigint as characters, 'sha256:' || sha256(v) as hash, n from bits b
           where h >= least and not (rule = 'entropy.base64' and exists (select 1 from bits x where x.doc_id = b.doc_id and x.rule = 'entropy.hex' and x.v = b.v and x.h >= 3.0))""")
def entropy_findings(spark, sf_dir):
    """K4, K5: runs of high entropy."""
    found = screening.findings(table(spark, sf_dir, "documents"), ["doc_id"], "text", ("entropy",))
    return found.groupBy("doc_id", "rule", F.col("characters").cast("long").alias("characters"), "hash").agg(F.count("*").alias("n"))


@query(f"""select doc_id, rule, a::bigint as "start" from {_KEYS} union all
           select doc_id, 'entropy.hex', (strpos(text, v) - 1)::bigint from (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[0-9a-fA-F]{{20,}}'))) as v from documents)
           where -list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)))) >= 3.0""")
def composite_findings(spark, sf_dir):
    """K6: both tiers together; a run that stands in a text twice counts at its first place."""
    found = screening.findings(decorated(spark, sf_dir, "keyed"), ["doc_id"], "text", ("signatures", "entropy")).where("rule <> 'entropy.base64'")
    return found.groupBy("doc_id", "rule", "hash").agg(F.min("start").cast("long").alias("start")).drop("hash")


_SUFFIXES = "['.HTML', '.md', '.pdf', '.xyz', '']"


@query(f"""select page_id, ({_SUFFIXES})[page_id % 5 + 1] as suffix, case page_id % 5 when 0 then 'text/html' when 1 then 'text/markdown' when 2 then 'application/pdf' end as media_type,
             case page_id % 5 when 0 then 'html@1' when 1 then 'markdown@1' when 2 then 'pdf_text@1' end as converter, case when page_id % 5 > 2 then 'unknown_format' end as reason from pages""")
def media_type_route(spark, sf_dir):
    """Suffix to media type to converter; what isn't known is skipped with a reason."""
    suffix = F.array(*map(F.lit, (".HTML", ".md", ".pdf", ".xyz", "")))[(F.col("page_id") % 5).cast("int")]
    rows = table(spark, sf_dir, "pages").select("page_id", suffix.alias("suffix"), F.concat(F.lit("p/"), F.col("page_id").cast("string"), suffix).alias("origin"), F.lit(None).cast("string").alias("reason"), F.lit("").alias("detail"), F.lit(1).alias("size_bytes"), F.lit(0.0).alias("modified_at"))
    judged = folders.classed(rows).withColumn("page_id", F.regexp_extract("origin", r"^p/(\d+)", 1).cast("long"))
    return judged.join(rows.select("page_id", "suffix"), "page_id").select("page_id", "suffix", "media_type", convert.standard().name_for(F.col("media_type")).alias("converter"), "reason")


@query("""select page_id, case when page_id % 6 = 0 then 'too_large' when page_id % 6 = 1 then 'unknown_format' when page_id % 6 = 2 then 'machinery' end as reason,
            case when page_id % 6 = 0 then (8388608 + page_id + 1) || ' bytes' when page_id % 6 = 1 then '(no suffix)' when page_id % 6 = 2 then '.git' end as detail from pages where page_id % 6 < 3""")
def listing_skips(spark, sf_dir):
    """What a listing doesn't offer, and why."""
    k = F.col("page_id") % 6
    rows = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.when(k == 1, "/x").otherwise("/x.md")).alias("origin"), F.when(k == 2, "machinery").alias("reason"), F.when(k == 2, ".git").otherwise("").alias("detail"), F.when(k == 0, 8388608 + F.col("page_id") + 1).otherwise(8388608).alias("size_bytes"), F.lit(0.0).alias("modified_at"))
    return folders.classed(rows).where("reason is not null").select(F.split("origin", "/")[0].cast("long").alias("page_id"), "reason", "detail")


@query("""with a as (select page_id, lower(regexp_replace(url, '[?#].*$', '')) as article from pages)
          select page_id, case when row_number() over w > 1 then first_value(page_id) over w end as duplicate_of from a window w as (partition by article order by page_id)""")
def article_dedup(spark, sf_dir):
    """The first page of an article in walk order stays."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_replace("url", "[?#].*$", "")).alias("article"))
    return folders.first_of_article(rows, order="page_id").select("page_id", "duplicate_of")


@query("""select page_id, case page_id % 5 when 1 then 'fetched_at is no bare string' when 2 then 'not a JSON object' when 3 then 'url is broken over lines' end as bad,
            case page_id % 5 when 0 then ['source_url', 'fetched_at'] when 4 then [] else [] end as keys, case page_id % 5 when 0 then url end as source_url from pages""")
def fetch_facts(spark, sf_dir):
    """Pages joined with their fetch records; every fault named."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("f/"), F.col("page_id").cast("string"), F.lit(".html")).alias("origin"))
    k = F.col("page_id") % 5
    body = F.when(k == 0, F.to_json(F.struct(F.col("url"), F.lit("2026-01-01").alias("fetched_at"), F.lit("x").alias("other")))).when(k == 1, F.to_json(F.struct(F.col("url"), F.lit(5).alias("fetched_at")))).when(k == 2, F.lit('["a"]')).when(k == 3, F.to_json(F.struct(F.concat("url", F.lit("\n")).alias("url"))))
    records = pages.where(k != 4).select("origin", body.alias("body"))
    known = folders.with_facts(pages, records)
    return known.select("page_id", "bad", F.col("facts.key").alias("keys"), folders.article().alias("source_url"))


@query("""select doc_id, case doc_id % 5 when 0 then 'Doc: ' || doc_id when 1 then 'Doc ' || doc_id when 2 then 'Under' when 3 then '' end as title from documents""")
def title_of(spark, sf_dir):
    """Stated titles, empty ones included, else first headings."""
    return decorated(spark, sf_dir, "fronted").select("doc_id", text.title(F.col("text")).alias("title"))


@query("""select doc_id, case doc_id % 5 when 0 then length('---.title: "Doc: ' || doc_id || '".layer: fact.---') when 2 then length('---.tags: x....') when 3 then length('---.title:.---') end::bigint as block_end,
            case doc_id % 5 when 0 then ['title', 'layer'] when 2 then ['tags'] when 3 then ['title'] end as keys from documents""")
def front_matter_block(spark, sf_dir):
    """The block of a document, and what it states."""
    own = text.block(F.col("text"))
    return decorated(spark, sf_dir, "fronted").select("doc_id", F.length(own).cast("long").alias("block_end"), F.when(own.isNotNull(), text.stated_keys(own)).alias("keys"))


@query(f"""with t as (select doc_id, text from {sql("fronted")}), m as (select doc_id, text, 'layer: fact' || chr(10) as a, 'producer: {text.PRODUCER}' || chr(10) as b from t),
             p as (select doc_id, text, case when doc_id % 5 in (1, 4) then 0 else 4 end as spot, case when doc_id % 5 in (1, 4) then '---' || chr(10) || a || b || '---' || chr(10) when doc_id % 5 = 0 then b else a || b end as piece from m)
           select doc_id, spot::bigint as "at", length(piece)::bigint as inserted, sha256(substr(text, 1, spot) || piece || substr(text, spot + 1)) as hash, case when spot > 0 then 3 when length(text) > 0 then 2 else 1 end as segments from p""")
def front_matter_insert(spark, sf_dir):
    """What the engine states, put where the document's own block wants it; the map moves along."""
    block = text.insertion(F.col("text"), text.matter())
    one = F.array(F.struct(F.lit(0).alias("out_start"), F.length("text").alias("out_end"), F.lit(0).alias("src_start"), F.length("text").alias("src_end"), F.lit("verbatim").alias("kind"), F.lit(None).cast("string").alias("rule")))
    rows = decorated(spark, sf_dir, "fronted").withColumn("b", block).withColumn("s", text.shifted(one, F.col("b.at"), F.col("b.inserted")))
    return rows.select("doc_id", F.col("b.at").cast("long").alias("at"), F.length("b.inserted").cast("long").alias("inserted"), F.sha2(text.inserted(F.col("text"), F.col("b.at"), F.col("b.inserted")), 256).alias("hash"), F.size("s").alias("segments"))


@query("""select doc_id, case doc_id % 5 when 0 then 'utf-8' when 1 then 'utf-8-sig' when 2 then 'utf-16' else null end as encoding, case doc_id % 5 when 1 then 3 when 2 then 2 when 0 then 0 end::bigint as bom,
            case when doc_id % 5 < 3 then sha256(text) end as hash, case when doc_id % 5 > 2 then 'undecodable' end as reason from documents""")
def decode_units(spark, sf_dir):
    """What bytes are read as; text with NULs or of no known encoding is refused, never guessed."""
    k = F.col("doc_id") % 5
    content = F.when(k == 0, F.encode("text", "utf-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "utf-8"))).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "utf-16le"))).when(k == 3, F.encode(F.concat("text", F.lit("\0")), "utf-8")).otherwise(F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF80"))))
    units = table(spark, sf_dir, "documents").select("doc_id", F.lit("text/plain").alias("media_type"), content.alias("content"))
    c = convert.convert(units).select("doc_id", "converted.*")
    return c.select("doc_id", "encoding", F.col("bom_bytes").cast("long").alias("bom"), F.when(F.col("reason").isNull(), F.sha2("text", 256)).alias("hash"), "reason")


@query("select doc_id, k::bigint as spot, (strlen(substr(text, 1, k)) + 3)::bigint as byte_offset from (select doc_id, text, unnest([0, length(text) // 2, length(text)]) as k from documents)")
def byte_offsets(spark, sf_dir):
    """A character's place in the bytes of its file."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(F.lit(0), F.floor(F.length("text") / 2).cast("int"), F.length("text"))).alias("k"))
    return rows.select("doc_id", F.col("k").cast("long").alias("spot"), text.byte_offset(F.col("text"), F.col("k"), F.lit(3)).cast("long").alias("byte_offset"))


@query("""select doc_id, not contains(v, chr(65533)) as same, length(v)::bigint as n_chars from (select doc_id, case when doc_id % 2 = 0 then text else text || chr(65533) end as v from documents)""")
def screened_bytes(spark, sf_dir):
    """K8: bytes of any kind as text for the screener; what isn't UTF-8 becomes a replacement character."""
    content = F.concat(F.encode("text", "utf-8"), F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.lit("FF"))))
    t = text.peeked(content)
    return table(spark, sf_dir, "documents").select("doc_id", (~t.contains("�")).alias("same"), F.length(t).cast("long").alias("n_chars"))


@query("select doc_id, 'sha256:' || sha256('{\"n\":' || length(text) || ',\"parent\":null,\"text\":\"' || sha256(text) || '\"}') as hash from documents")
def canonical_hash(spark, sf_dir):
    """Hashes of records in one canonical form."""
    body = text.canonical_column(n=F.length("text"), parent=F.lit(None).cast("string"), text=F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(body).alias("hash"))


@query("select * from (values (1, 'failed', true, 2), (1, 'failed', false, 6), (2, 'failed', false, 1), (3, 'refused', false, 4)) t(exit_code, outcome, retryable, kinds)")
def error_kinds(spark, sf_dir):
    """The catalogue of errors by what a caller may do."""
    return errors.catalogue(spark).groupBy("exit_code", "outcome", "retryable").agg(F.count("*").cast("int").alias("kinds"))
