"""Queries of the rule language, rule matching, findings and the rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators.detect import (
    build_findings,
    detect,
    findings_as_events,
    match_rules,
    prepare_events,
    prepare_table,
)
from eventlake.operators.envelope import EMPTY_METADATA
from eventlake.operators.netjoin import longest_network
from eventlake.operators.normalise import tag_logsource
from eventlake.operators.rules import (
    RULE_SCHEMA,
    filter_rules,
    get_rule,
    list_rules,
    merge_rules,
    rule_facets,
    rule_from_dict,
    set_enabled,
    switch_rules,
)
from eventlake.plans.registry import query
from eventlake.plans.sample_rules import EVENT_RULES, HITS, equality_rules, threshold_rules
from eventlake.plans.tables import EV, model_events, table, typed_events
from eventlake.functions.variants import get, strict_string


def rule(rule_id: str, condition: str = "sel", logsource: dict | None = None, level: str = "medium", **selections):
    detection = {**selections, "condition": condition}
    return rule_from_dict(
        {"id": rule_id, "title": rule_id, "level": level, "detection": detection, "logsource": logsource}
    )


def on_table(df: DataFrame, key: str, *rules) -> DataFrame:
    return match_rules(prepare_table(df), rules, keep=[key])


def text_events(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Events whose VARIANT data holds the given columns."""
    return df.select(
        F.col(key),
        F.to_variant_object(F.struct(*columns)).alias("data"),
        F.expr(EMPTY_METADATA).alias("metadata"),
    )


@query(
    "detect_eq",
    """SELECT event_id, 'eq' AS rule_id FROM events WHERE event_type IN ('error', 'purchase') AND user_id IN (3, 5, 8)""",
)
def detect_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rule("eq", sel={"event_type": ["ERROR", "Purchase"], "user_id": [3, 5, "8"]})
    return on_table(typed_events(spark, sf_dir), "event_id", r)


@query(
    "detect_contains",
    """SELECT doc_id, 'licence' AS rule_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'apache')
       UNION ALL SELECT doc_id, 'personal' FROM documents WHERE contains(lower(text), '@mail') AND lower(lang) = 'en'""",
)
def detect_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_table(
        table(spark, sf_dir, "documents"),
        "doc_id",
        rule("licence", sel={"text|contains": ["License", "APACHE"]}),
        rule("personal", sel={"text|contains": "@Mail", "lang": "EN"}),
    )


@query(
    "detect_all",
    """SELECT doc_id, 'all' AS rule_id FROM documents WHERE contains(lower(text), 'the ') AND contains(lower(text), 'and ')
       AND contains(lower(text), 'license')""",
)
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rule("all", sel={"text|contains|all": ["The ", "And ", "License"]})
    return on_table(table(spark, sf_dir, "documents"), "doc_id", r)


@query(
    "detect_affixes",
    """SELECT page_id, 'start' AS rule_id FROM pages WHERE lower(url) LIKE 'https://m.%'
       UNION ALL SELECT page_id, 'end' FROM pages WHERE lower(url) LIKE '%#top' OR lower(url) LIKE '%/'
       UNION ALL SELECT page_id, 'html' FROM pages WHERE lower(html) LIKE '%</html>' AND lower(url) LIKE 'http:%'""",
)
def detect_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_table(
        table(spark, sf_dir, "pages"),
        "page_id",
        rule("start", sel={"url|startswith": "HTTPS://m."}),
        rule("end", sel={"url|endswith": ["#TOP", "/"]}),
        rule("html", sel={"html|endswith": "</HTML>", "url|startswith": "http:"}),
    )


@query(
    "detect_wildcard",
    """SELECT page_id, 'wild' AS rule_id FROM pages WHERE lower(url) LIKE 'http%.example.org/__/%5%'
       UNION ALL SELECT page_id, 'query' FROM pages WHERE contains(url, '?page=')""",
)
def detect_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_table(
        table(spark, sf_dir, "pages"),
        "page_id",
        rule("wild", sel={"url": "http*.Example.org/??/*5*"}),
        rule("query", sel={"url": r"*\?page=*"}),
    )


@query(
    "detect_re",
    r"""SELECT doc_id, 'mail' AS rule_id FROM documents WHERE regexp_matches(text, '[a-z]+\.[0-9]+@mail[0-9]\.example\.com')
        UNION ALL SELECT doc_id, 'lic' FROM documents WHERE regexp_matches(text, '(?i)LICENSE.{0,20}version')""",
)
def detect_re(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_table(
        table(spark, sf_dir, "documents"),
        "doc_id",
        rule("mail", sel={"text|re": r"[a-z]+\.[0-9]+@mail[0-9]\.example\.com"}),
        rule("lic", sel={"text|re|i": "LICENSE.{0,20}version"}),
    )


@query(
    "detect_cased",
    """SELECT doc_id, 'cased' AS rule_id FROM documents WHERE contains(text, 'License') OR contains(text, 'THE')""",
)
def detect_cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rule("cased", sel={"text|contains|cased": ["License", "THE"]})
    return on_table(table(spark, sf_dir, "documents"), "doc_id", r)


@query(
    "detect_numeric",
    f"""WITH {EV} SELECT event_id, 'num' AS rule_id FROM ev WHERE value > 50 AND value <= 100.5 AND k >= 10
        UNION ALL SELECT event_id, 'low' FROM ev WHERE value < 1 OR k < 1""",
)
def detect_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_table(
        typed_events(spark, sf_dir),
        "event_id",
        rule("num", sel={"value|gt": 50, "value|lte": 100.5, "k|gte": 10}),
        rule("low", sel=[{"value|lt": 1}, {"k|lt": 1}]),
    )


_OPT = "CASE WHEN event_id % 7 IN (0, 1) THEN '' WHEN event_id % 7 = 2 THEN '\"opt\":null,' ELSE '\"opt\":' || CAST(event_id AS STRING) || ',' END"


@query(
    "detect_exists",
    """SELECT event_id, 'there' AS rule_id FROM events WHERE event_id % 7 NOT IN (0, 1)
       UNION ALL SELECT event_id, 'gone' FROM events WHERE event_id % 7 IN (0, 1)
       UNION ALL SELECT event_id, 'null' FROM events WHERE event_id % 7 IN (0, 1, 2)""",
)
def detect_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("{"), F.expr(_OPT), F.lit('"n":1}'))
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.parse_json(body).alias("data"), F.expr(EMPTY_METADATA).alias("metadata")
    )
    rules = [
        rule("there", sel={"opt|exists": True}),
        rule("gone", sel={"opt|exists": False}),
        rule("null", sel={"opt": None}),
    ]
    return match_rules(prepare_events(ev), rules)


@query(
    "detect_not",
    """SELECT event_id, 'not' AS rule_id FROM events WHERE event_type = 'error' AND event_id % 7 <> 3""",
)
def detect_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing or null field is false, so its negation holds."""
    body = F.concat(F.lit("{"), F.expr(_OPT), F.lit('"t":"'), F.col("event_type"), F.lit('","seven":'),
                    (F.col("event_id") % 7).cast("string"), F.lit("}"))
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.parse_json(body).alias("data"), F.expr(EMPTY_METADATA).alias("metadata")
    )
    r = rule("not", "sel and not (known and seven)", sel={"t": "error"}, known={"opt|gte": 0}, seven={"seven": 3})
    return match_rules(prepare_events(ev), [r])


@query(
    "detect_one_of",
    f"""WITH {EV} SELECT event_id, 'one' AS rule_id FROM ev WHERE (k = 7 OR value > 200) AND NOT (event_type = 'view' AND k > 50)
        UNION ALL SELECT event_id, 'two' FROM ev
          WHERE CAST(k > 50 AS INT) + CAST(value > 50 AS INT) + CAST(event_type = 'click' AS INT) >= 2
        UNION ALL SELECT event_id, 'every' FROM ev WHERE k > 90 AND value > 90""",
)
def detect_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_table(
        typed_events(spark, sf_dir),
        "event_id",
        rule(
            "one", "1 of sel_* and not all of drop_*",
            sel_k={"k": 7}, sel_v={"value|gt": 200}, drop_t={"event_type": "view"}, drop_k={"k|gt": 50},
        ),
        rule("two", "2 of them", a={"k|gt": 50}, b={"value|gt": 50}, c={"event_type": "click"}),
        rule("every", "all of them", a={"k|gt": 90}, b={"value|gt": 90}, _off={"k": -1}),
    )


@query(
    "detect_fieldref",
    f"""WITH {EV} SELECT event_id, 'same' AS rule_id FROM ev WHERE k = user_id
        UNION ALL SELECT event_id, 'inside' FROM ev WHERE contains(props, CAST(user_id AS VARCHAR))""",
)
def detect_fieldref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_table(
        typed_events(spark, sf_dir),
        "event_id",
        rule("same", sel={"k|fieldref": "user_id"}),
        rule("inside", sel={"props|contains|fieldref": "user_id"}),
    )


@query(
    "detect_keywords",
    """SELECT conv_id * 1000 + turn AS event_id, 'words' AS rule_id FROM conversations
       WHERE contains(lower(text), 'tion ') OR contains(lower(role), 'system') OR contains(lower(text), chr(10) || 'a')""",
)
def detect_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any text value of a VARIANT body, but not its keys."""
    conv = table(spark, sf_dir, "conversations").withColumn("event_id", F.expr("conv_id * 1000 + turn"))
    ev = text_events(conv, "event_id", "role", "text", "turn")
    return match_rules(prepare_events(ev), [rule("words", sel=["TION ", "system", "\nA", "turn\":"])])


@query(
    "detect_base64",
    """SELECT conv_id * 1000 + turn AS event_id, 'b64' AS rule_id FROM conversations
       WHERE contains(to_base64(encode(text)), 'dGlvbiB0aG') OR contains(to_base64(encode(text)), 'Rpb24gdGhl')
          OR contains(to_base64(encode(text)), '0aW9uIHRoZ')
       UNION ALL SELECT conv_id * 1000 + turn, 'wide' FROM conversations WHERE contains(text, 'ing and')""",
)
def detect_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'tion the' at any offset of a Base64 text, and a word in UTF-16 text."""
    wide = F.make_valid_utf8(F.encode("text", "UTF-16LE").cast("string"))
    conv = table(spark, sf_dir, "conversations").select(
        F.expr("conv_id * 1000 + turn").alias("event_id"),
        F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\\r\\n]", "").alias("enc"),
        wide.alias("wide"),
    )
    return on_table(
        conv,
        "event_id",
        rule("b64", sel={"enc|base64offset|contains|cased": "tion the"}),
        rule("wide", sel={"wide|wide|contains|cased": "ing and"}),
    )


@query(
    "detect_windash",
    "SELECT event_id, 'dash' AS rule_id FROM events WHERE event_id % 5 IN (0, 1, 2) AND event_type = 'error'",
)
def detect_windash(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        "concat('run ', CASE event_id % 5 WHEN 0 THEN '-enc' WHEN 1 THEN '/ENC' WHEN 2 THEN '–enc' "
        "WHEN 3 THEN 'enc' ELSE '+enc' END, ' ', event_type)"
    )
    ev = table(spark, sf_dir, "events").select("event_id", line.alias("cmd"))
    return on_table(ev, "event_id", rule("dash", sel={"cmd|windash|contains": "run -enc error"}))


_IPS = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


@query(
    "detect_cidr",
    rf"""WITH ips AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_IPS}')) AS ip FROM documents),
         nums AS (SELECT doc_id, list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)) AS p FROM ips),
         ok AS (SELECT doc_id, p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4] AS n FROM nums
                WHERE greatest(p[1], p[2], p[3], p[4]) <= 255)
         SELECT DISTINCT doc_id, 'low' AS rule_id FROM ok WHERE n < 2147483648
         UNION ALL SELECT DISTINCT doc_id, 'net' FROM ok WHERE n // 67108864 IN (16, 58)""",
)
def detect_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_extract_all("text", F.lit(f"({_IPS})"), 1).alias("ips")
    )
    return on_table(
        found,
        "doc_id",
        rule("low", sel={"ips|cidr": "0.0.0.0/1"}),
        rule("net", sel={"ips|cidr": ["64.0.0.0/6", "232.0.0.0/6"]}),
    )


@query(
    "detect_cidr6",
    f"""WITH {EV} SELECT event_id, 'six' AS rule_id FROM ev WHERE user_id BETWEEN 16 AND 31""",
)
def detect_cidr6(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.lit("2001:DB8:"), F.hex("user_id"), F.lit("::"), F.lower(F.hex("k")))
    ev = typed_events(spark, sf_dir).select("event_id", address.alias("ip"))
    return on_table(ev, "event_id", rule("six", sel={"ip|cidr": ["2001:db8:10::/44", "10.0.0.0/8"]}))


@query(
    "detect_nested_array",
    f"""WITH {EV} SELECT event_id, 'tag' AS rule_id FROM ev WHERE event_type = 'click' OR source_id = 'src-1'
        UNION ALL SELECT event_id, 'user' FROM ev WHERE user_id + 1 = 12 OR user_id = 12
        UNION ALL SELECT event_id, 'deep' FROM ev WHERE k > 95""",
)
def detect_nested_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on arrays goes through the rule index here, with one hit per event and rule."""
    users = F.array(*[F.struct((F.col("user_id") + i).alias("uid")) for i in (0, 1)])
    ev = typed_events(spark, sf_dir).select(
        F.col("event_id"),
        F.array("event_type", "source_id").alias("tags"),
        users.alias("records"),
        F.struct(F.struct("k").alias("b")).alias("a"),
    )
    rules = [
        rule("tag", sel={"tags": ["CLICK", "src-1"]}),
        rule("user", sel={"records.uid": 12}),
        rule("deep", sel={"a.b.k|gt": 95}),
    ]
    events = text_events(ev, "event_id", "tags", "records", "a")
    return match_rules(prepare_events(events), rules, strategy="index")


@query(
    "detect_logsource",
    f"""WITH {EV} SELECT id AS event_id, 'shop' AS rule_id FROM ev WHERE k = 1
        UNION ALL SELECT id, 'view' FROM ev WHERE event_type = 'view' AND k = 2
        UNION ALL SELECT id, 'any' FROM ev WHERE k = 3""",
)
def detect_logsource(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        rule("shop", sel={"k": 1}, logsource={"product": "shop"}),
        rule("view", sel={"k|gte": 2, "k|lte": 2}, logsource={"product": "shop", "service": "view"}),
        rule("any", sel={"k": 3}),
        rule("other", sel={"k|gte": 0}, logsource={"product": "windows"}),
        rule("category", sel={"k|gte": 0}, logsource={"product": "shop", "category": "web"}),
    ]
    return match_rules(prepare_events(model_events(spark, sf_dir)), rules)


@query(
    "detect_tagged_logsource",
    f"""WITH {EV} SELECT id AS event_id, 'aws' AS rule_id FROM ev WHERE user_id = 4""",
)
def detect_tagged_logsource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag of normalisation is what matching reads, when the event brings no logsource itself."""
    bare = model_events(spark, sf_dir).withColumn("metadata", F.map_filter("metadata", lambda k, _: k != "logsource"))
    tagged = tag_logsource(bare, product="aws", service="cloudtrail")
    rules = [
        rule("aws", sel={"user.uid": 4}, logsource={"product": "aws", "service": "cloudtrail"}),
        rule("okta", sel={"user.uid": 4}, logsource={"product": "okta"}),
    ]
    return match_rules(prepare_events(tagged), rules)


@query("detect_multi_rule", f"WITH {EV}, {HITS} SELECT event_id, rule_id FROM hits")
def detect_multi_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_table(typed_events(spark, sf_dir), "event_id", *EVENT_RULES)


_KINDS = "CASE i % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END"


@query(
    "detect_rule_join",
    f"""SELECT event_id, 'q' || CAST(i AS VARCHAR) AS rule_id FROM events
        JOIN (SELECT i, {_KINDS} AS kind FROM range(400) t(i)) ON event_type = kind AND user_id = i // 5""",
)
def detect_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many equality rules: one hash join, still one pass over the events."""
    return on_table(typed_events(spark, sf_dir), "event_id", *equality_rules(400))


_FINDING_SQL = """SELECT 2004 AS class_uid, time_ms, level AS severity, rule_id, title, id AS uid,
    sha256(id || chr(1) || rule_id) AS finding_uid, id AS correlation_uid, 'EventLake' AS vendor FROM hits"""


def flat_findings(findings: DataFrame) -> DataFrame:
    return findings.select(
        "class_uid",
        F.unix_millis("time").alias("time_ms"),
        "severity",
        "rule_id",
        F.col("finding_info.title").alias("title"),
        F.col("metadata.uid").alias("uid"),
        F.col("finding_info.uid").alias("finding_uid"),
        F.col("metadata.correlation_uid").alias("correlation_uid"),
        F.col("metadata.product.vendor_name").alias("vendor"),
    )


def sample_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the sample rules over the typed events."""
    ev = typed_events(spark, sf_dir).withColumns(
        {"time": F.timestamp_millis("time_ms"), "correlation_uid": F.col("id"), "__id": F.col("id")}
    )
    hits = match_rules(prepare_table(ev), EVENT_RULES, keep=["__id", "time", "correlation_uid"])
    return build_findings(hits.withColumnRenamed("__id", "event_id"), EVENT_RULES)


@query("findings", f"WITH {EV}, {HITS} {_FINDING_SQL}")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(sample_findings(spark, sf_dir))


_MODEL_RULES_SQL = """hits AS (SELECT *, 'm1' AS rule_id, 'm1' AS title, 'high' AS level FROM ev WHERE event_type = 'error' AND k < 10
    UNION ALL SELECT *, 'm2', 'm2', 'low' FROM ev WHERE user_id = 7)"""


def _model_rules():
    return [
        rule("m1", sel={"activity_name": "error", "k|lt": 10}, level="high"),
        rule("m2", sel={"user.uid": 7}, level="low", logsource={"product": "shop"}),
    ]


@query("findings_model", f"WITH {EV}, {_MODEL_RULES_SQL} {_FINDING_SQL}")
def findings_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(detect(model_events(spark, sf_dir), _model_rules()))


@query(
    "findings_inherit",
    f"""WITH {EV}, {_MODEL_RULES_SQL} SELECT sha256(id || chr(1) || rule_id) AS event_id, id AS uid, source_id,
        event_type AS service, 'true' AS ocsf, 'true' AS product_flag FROM hits""",
)
def findings_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings are events again: they carry on the event's metadata, plus two marks."""
    found = findings_as_events(detect(model_events(spark, sf_dir), _model_rules(), keep_metadata=True))
    entry = lambda name: F.try_element_at("metadata", F.lit(name))
    return found.select(
        "event_id",
        get(F.col("data"), "metadata", "uid", to="string").alias("uid"),
        strict_string(entry("source_id")).alias("source_id"),
        get(entry("logsource"), "service", to="string").alias("service"),
        F.try_variant_get(entry("ocsf"), "$", "string").alias("ocsf"),
        F.try_variant_get(entry("eventlake"), "$", "string").alias("product_flag"),
    )


@query(
    "findings_correlation",
    f"""WITH {EV} SELECT id AS uid, CASE event_id % 3 WHEN 0 THEN 'c-' || id ELSE id END AS correlation_uid
        FROM ev WHERE event_type = 'error'""",
)
def findings_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text `metadata.uid` of the source correlates; a numeric or missing one does not."""
    body = F.expr(
        """concat('{"t":"', event_type, '"', CASE event_id % 3 WHEN 0 THEN ',"metadata":{"uid":"c-' || event_id || '"}'
           WHEN 1 THEN ',"metadata":{"uid":17}' ELSE '' END, '}')"""
    )
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.parse_json(body).alias("data"),
        F.expr(EMPTY_METADATA).alias("metadata"),
    )
    return detect(ev, [rule("t", sel={"t": "error"})]).select("metadata.uid", "metadata.correlation_uid")


@query(
    "rule_disabled",
    f"WITH {EV}, {HITS} SELECT event_id, rule_id FROM hits WHERE rule_id NOT IN ('r0', 'r9')",
)
def rule_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = set_enabled(set_enabled(EVENT_RULES, "r0", False), "r9", False)
    return on_table(typed_events(spark, sf_dir), "event_id", *rules)


# --- the rule table, derived from `part` --------------------------------------------------------

_PART_RULES = """rules AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS id, p_name AS title,
    CASE WHEN p_partkey % 4 > 0 THEN p_name || ' of ' || p_brand END AS description, p_partkey % 2 = 0 AS enabled,
    CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS level,
    p_brand AS product, p_type AS category, CASE WHEN p_size > 25 THEN 'svc' ELSE '' END AS service,
    'Author ' || CAST(p_size AS VARCHAR) AS author, ['Size.' || CAST(p_size AS VARCHAR), p_type] AS tags FROM part)"""


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule rows, one per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "'p' || CAST(p_partkey AS STRING) AS id",
        "p_name AS title",
        "CASE WHEN p_partkey % 4 > 0 THEN p_name || ' of ' || p_brand END AS description",
        "p_partkey % 2 = 0 AS enabled",
        "CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS level",
        "named_struct('product', p_brand, 'service', CASE WHEN p_size > 25 THEN 'svc' ELSE '' END, 'category', p_type) AS logsource",
        "'Author ' || CAST(p_size AS STRING) AS author",
        "array('Size.' || CAST(p_size AS STRING), p_type) AS tags",
        "'{}' AS body",
    ).to(spark.createDataFrame([], RULE_SCHEMA).schema)


@query(
    "rule_list",
    f"""WITH {_PART_RULES} SELECT id, title, description, enabled, level, product FROM rules
        WHERE description IS NOT NULL AND level IS NOT NULL""",
)
def rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = list_rules(part_rules(spark, sf_dir))
    return listed.select("id", "title", "description", "enabled", "level", F.col("logsource.product").alias("product"))


@query("rule_get", f"WITH {_PART_RULES} SELECT id, title, author FROM rules WHERE id = 'p17'")
def rule_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get_rule(part_rules(spark, sf_dir), "p17").select("id", "title", "author")


@query(
    "rule_filter",
    f"""WITH {_PART_RULES} SELECT id, level FROM rules WHERE service = 'svc' AND (level IS NULL OR level IN ('high', 'critical'))
        AND (contains(lower(title), 'ring') OR contains(lower(coalesce(description, '')), 'ring')
             OR contains(lower(author), 'ring') OR len(list_filter(tags, lambda t: contains(lower(t), 'ring'))) > 0)
        UNION ALL SELECT id, level FROM rules WHERE category = 'ECONOMY' AND len(list_filter(tags, lambda t: contains(lower(t), 'size.1'))) > 0""",
)
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = part_rules(spark, sf_dir)
    by_text = filter_rules(rules, service="svc", levels=["high", "critical"], search="RING")
    by_tag = filter_rules(rules, category="ECONOMY", search="size.1")
    return by_text.unionByName(by_tag).select("id", "level")


@query(
    "rule_facets",
    f"""WITH {_PART_RULES} SELECT
        (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT category AS x FROM rules)) AS categories,
        (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT product AS x FROM rules)) AS products,
        'svc' AS services,
        (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT level AS x FROM rules WHERE level IS NOT NULL)) AS levels""",
)
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = rule_facets(part_rules(spark, sf_dir))
    return row.select(*[F.array_join(c, ",").alias(c) for c in row.columns])


@query(
    "rule_merge",
    f"""WITH {_PART_RULES}, new AS (SELECT 'p' || CAST(p_partkey * 2 AS VARCHAR) AS id FROM part)
        SELECT 'merged' AS part, count(*) AS n FROM (SELECT id FROM rules UNION SELECT id FROM new)
        UNION ALL SELECT 'conflict', count(*) FROM new WHERE id IN (SELECT id FROM rules)""",
)
def rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = part_rules(spark, sf_dir)
    new = rules.withColumn("id", F.concat(F.lit("p"), (F.substring("id", 2, 20).cast("bigint") * 2).cast("string")))
    merged, conflicts = merge_rules(rules, new)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(merged, "merged").unionByName(count(conflicts, "conflict"))


@query(
    "rule_switch",
    f"""WITH {_PART_RULES} SELECT enabled OR id IN ('p1', 'p3') AS enabled, count(*) AS n FROM rules GROUP BY 1""",
)
def rule_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    switched = switch_rules(part_rules(spark, sf_dir), ["p1", "p3"], True)
    return switched.groupBy("enabled").agg(F.count(F.lit(1)).alias("n"))


@query(
    "detect_2000_predicate_rules",
    f"""WITH {EV} SELECT event_id, 't' || i AS rule_id FROM ev JOIN range(2000) r(i)
        ON event_type = (['click', 'error', 'purchase', 'signup', 'view'])[i % 5 + 1] AND value > 100 + i AND contains(props, CAST(i % 10 AS VARCHAR))""",
)
def detect_2000_predicate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of rules that are no plain equalities, through the rule index."""
    return match_rules(prepare_table(typed_events(spark, sf_dir)), threshold_rules(2000), keep=["event_id"])


def page_patterns(count: int) -> list[str]:
    """Patterns over addresses; most hold a literal, every fiftieth none."""
    tongues = ["en", "de", "fr", "es"]
    return [f"[{i % 10}]{{2}}" if i % 50 == 7 else f"(?i)/{tongues[i % 4]}/{i}(\\D|$)" for i in range(count)]


@query(
    "detect_1000_patterns",
    r"""SELECT page_id, 'p' || i AS rule_id FROM pages JOIN range(1000) r(i) ON regexp_matches(url,
       CASE WHEN i % 50 = 7 THEN '[' || (i % 10) || ']{2}' ELSE '(?i)/' || (['en', 'de', 'fr', 'es'])[i % 4 + 1] || '/' || i || '(\D|$)' END)""",
)
def detect_1000_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular expressions found by the literals that their matches must hold; those without one are tried on every event."""
    rules = [rule(f"p{i}", sel={"url|re": p}) for i, p in enumerate(page_patterns(1000))]
    return match_rules(prepare_table(table(spark, sf_dir, "pages")), rules, keep=["page_id"])


# Addresses and networks from the same numbers in both engines: IPv4 as one number, IPv6 by its upper 64 bits.
_NETS = """four AS (SELECT i AS network_id, (10 << 24) + ((i % 200) << 16) + (((i * 7) % 100) << 8) + (i * 13) % 256 AS net,
        ([8, 16, 20, 24, 27, 32])[i % 6 + 1] AS bits FROM range(3000) r(i)),
    six AS (SELECT 3000 + i AS network_id, 536939960 * 4294967296 + ((i % 150) << 16) + (i * 3) % 100 AS net, ([32, 48, 56, 62, 64])[i % 5 + 1] AS bits FROM range(1000) r(i)),
    a AS (SELECT event_id, event_type = 'click' AS is6, (10 << 24) + ((user_id % 200) << 16) + (k << 8) + event_id % 250 AS n4,
        536939960 * 4294967296 + (user_id << 16) + k AS n6 FROM ev),
    m AS (SELECT event_id, network_id, bits FROM a JOIN four ON NOT is6 AND (n4 >> (32 - bits)) = (net >> (32 - bits))
        UNION ALL SELECT event_id, network_id, bits FROM a JOIN six ON is6 AND (n6 >> (64 - bits)) = (net >> (64 - bits)))"""


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.concat_ws(".", F.lit("10"), F.col("user_id") % 200, F.col("k"), F.col("event_id") % 250)
    six = F.concat(F.lit("2001:db8:"), F.hex("user_id"), F.lit(":"), F.hex("k"), F.lit("::"), F.hex(F.col("event_id") % 65536))
    return typed_events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "click", six).otherwise(four).alias("ip"))


def networks(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    four = F.concat_ws(".", F.lit("10"), i % 200, (i * 7) % 100, (i * 13) % 256)
    bits4 = F.element_at(F.array(*map(F.lit, (8, 16, 20, 24, 27, 32))), (i % 6 + 1).cast("int"))
    six = F.concat(F.lit("2001:db8:"), F.hex(i % 150), F.lit(":"), F.hex((i * 3) % 100), F.lit("::"))
    bits6 = F.element_at(F.array(*map(F.lit, (32, 48, 56, 62, 64))), (i % 5 + 1).cast("int"))
    return (
        spark.range(3000).select(i.alias("network_id"), F.concat(four, F.lit("/"), bits4).alias("cidr"))
        .union(spark.range(1000).select((i + 3000).alias("network_id"), F.concat(six, F.lit("/"), bits6).alias("cidr")))
    )


@query(
    "detect_networks",
    f"""WITH {EV}, {_NETS} SELECT event_id, network_id, bits FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY bits DESC, network_id) AS nth FROM m) WHERE nth = 1""",
)
def detect_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's longest matching network of four thousand, IPv4 and IPv6."""
    return longest_network(addressed(spark, sf_dir), ["event_id"], "ip", networks(spark), "network_id")


@query("detect_network_rules", f"""WITH {EV}, {_NETS} SELECT event_id, 'n' || network_id AS rule_id FROM m WHERE network_id % 3 = 1""")
def detect_network_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen hundred rules with a network each, through the rule index."""
    rules = [rule(f"n{r['network_id']}", sel={"ip|cidr": r["cidr"]}) for r in networks(spark).where("network_id % 3 = 1").collect()]  # a fixed set of rules
    return match_rules(prepare_table(addressed(spark, sf_dir)), rules, keep=["event_id"])
