"""Captions, terms and vocabularies over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicon import CANONICAL, CLEAN_STOP, CORE_TAGS, FALLBACK_TAGS, GT_EXPANSION, PLURALS, PROMPT_GROUPS, RULE_ALIASES, STOP, SYNONYMS, TERM_CLASSES
from ..operators import metrics, procedural, vocab
from . import fixtures as fx
from .evidence_queries import _EQ_TERMS, _term_table
from .fixtures import q6 as r6
from .geometry_queries import r6s, rounded
from .registry import query


def _in(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def clean_open_sql(c: str) -> str:
    low = rf"trim(trim(regexp_replace(regexp_replace(replace(lower({c}), '_', ' '), '[^a-z0-9 -]+', ' ', 'g'), '\s+', ' ', 'g')), ' -')"
    last = rf"regexp_extract({low}, '([^ ]*)$', 1)"
    one = f"CASE WHEN ends_with({last}, 'ies') AND length({last}) > 4 THEN {low}[:-4] || 'y' WHEN ends_with({last}, 's') AND NOT ends_with({last}, 'ss') AND length({last}) > 3 THEN {low}[:-2] ELSE {low} END"
    return f"(CASE WHEN {one} IN {_in(CLEAN_STOP)} THEN '' ELSE {one} END)"


def clean_text_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[_-]', ' ', 'g'), '[^a-z0-9 /,;]+', ' ', 'g'), '\s+', ' ', 'g'))"


def normalize_sql(c: str, keep_roof: bool = False) -> str:
    clean = clean_text_sql(c)
    plural = f"coalesce({_map(PLURALS)}[{clean}], {clean})"
    mapped = f"coalesce({_map(SYNONYMS)}[{plural}], {plural})"
    if not keep_roof:
        mapped = f"replace('^' || {mapped} || '$', '^roof$', '^building$')[2:-2]"
    return f"(CASE WHEN {clean} = '' OR {clean} IN {_in(STOP)} OR {mapped} IN {_in(STOP)} OR length({mapped}) < 3 THEN NULL ELSE {mapped} END)"


_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _docs(spark, sf):
    return fx.load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))


@query(f"WITH {_DOCS} SELECT doc_id, {clean_open_sql('t')} AS open_term, {clean_text_sql('t')} AS clean FROM d")
def clean_terms(spark, sf):
    return _docs(spark, sf).select("doc_id", text.clean_open_term(F.col("t")).alias("open_term"), text.clean_text(F.col("t")).alias("clean"))


_WORDS = "w AS (SELECT DISTINCT x FROM (SELECT unnest(['The Houses', 'roofs', 'Bare_Soil', 'cars!', 'scenery', 'a', 'area', 'Parking-lots', 'buses', 'glasses', 'ox', 'berries', 'RIVER', 'woodland', 'stone ferries', '', ' -roof- ']) AS x UNION ALL SELECT p_name FROM part UNION ALL SELECT p_type FROM part))"


def _words(spark, sf):
    p = fx.load(spark, sf, "part")
    fixed = spark.createDataFrame([(x,) for x in ("The Houses", "roofs", "Bare_Soil", "cars!", "scenery", "a", "area", "Parking-lots", "buses", "glasses", "ox", "berries", "RIVER", "woodland", "stone ferries", "", " -roof- ")], "x string")
    return fixed.unionByName(p.select(F.col("p_name").alias("x"))).unionByName(p.select(F.col("p_type").alias("x"))).distinct()


@query(f"WITH {_WORDS} SELECT x, {normalize_sql('x')} AS term, {normalize_sql('x', True)} AS with_roof FROM w")
def normalise_terms(spark, sf):
    return _words(spark, sf).select("x", text.normalize_term(F.col("x")).alias("term"), text.normalize_term(F.col("x"), keep_roof=True).alias("with_roof"))


def _alias_map() -> str:
    first = {}
    for k, names in RULE_ALIASES.items():
        for n in names:
            first.setdefault(n, k)
    return "MAP {" + ", ".join(f"'{n}': {k}" for n, k in first.items()) + "}"


@query(f"WITH {_WORDS}, c AS (SELECT x, {clean_open_sql('x')} AS c FROM w) SELECT x, coalesce({_alias_map()}[CASE WHEN c <> '' THEN c ELSE lower(trim(x)) END], 0) AS class_id FROM c")
def rule_map(spark, sf):
    return _words(spark, sf).select("x", text.rule_class(F.col("x")).alias("class_id"))


@query(r"SELECT o_orderkey, coalesce(TRY_CAST(regexp_extract(a, '\b(24|20|18|14|13|6|4|3|1)\b', 1) AS INTEGER), 0) AS class_id FROM (SELECT o_orderkey, 'The class is ' || (o_custkey % 30) || ', not ' || (o_orderkey % 7) AS a FROM orders)")
def parse_answers(spark, sf):
    o = fx.load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("The class is "), (F.col("o_custkey") % 30).cast("string"), F.lit(", not "), (F.col("o_orderkey") % 7).cast("string")).alias("a"))
    return o.select("o_orderkey", text.answer_class(F.col("a"), [1, 3, 4, 6, 13, 14, 18, 20, 24]).alias("class_id"))


_PHRASES = rf"""{fx.CAPTIONS},
heads AS (SELECT frame_id, caption_idx, regexp_replace(lower(text), '^[\s\-*\d.)]+', '') AS h FROM captions), parts AS (SELECT frame_id, caption_idx, string_split_regex(h, '[,;/\n]|\band\b|\bwith\b|\bplus\b') AS p FROM heads),
bare AS (SELECT frame_id, caption_idx, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM parts), cleaned AS (SELECT frame_id, caption_idx, i, regexp_replace(p, '\b(a|an|the|some|several|multiple|visible)\b', ' ', 'g') AS p FROM bare),
opened AS (SELECT frame_id, caption_idx, i, {clean_open_sql('p')} AS term FROM cleaned),
phrases AS (SELECT frame_id, caption_idx, row_number() OVER (PARTITION BY frame_id, caption_idx ORDER BY i) - 1 AS pos, term FROM opened WHERE term <> '' AND len(string_split(term, ' ')) <= 5)"""


@query(f"WITH {_PHRASES} SELECT frame_id, caption_idx, pos, term FROM phrases")
def phrase_candidates(spark, sf):
    return vocab.caption_phrases(fx.captions(spark, sf))


_FREQ = "freq AS (SELECT frame_id, term, count(*) AS freq, min(caption_idx * 100000 + pos) AS first FROM phrases GROUP BY ALL), ranked AS (SELECT frame_id, term, freq, row_number() OVER (PARTITION BY frame_id ORDER BY freq DESC, first) AS rank FROM freq)"


@query(f"WITH {_PHRASES}, {_FREQ} SELECT frame_id, term, freq, CASE WHEN rank <= 10 THEN rank END AS rank FROM ranked")
def term_frequency(spark, sf):
    return vocab.term_frequency(fx.captions(spark, sf), max_tags=10)


@query(f"WITH {_PHRASES}, {_FREQ} SELECT frame_id, (SELECT count(*) FROM captions c WHERE c.frame_id = f.frame_id) AS captions, (SELECT string_agg(term, '|' ORDER BY caption_idx, pos) FROM phrases p WHERE p.frame_id = f.frame_id) AS raw_terms, (SELECT string_agg(term, '|' ORDER BY rank) FROM ranked r WHERE r.frame_id = f.frame_id AND rank <= 24) AS normalized_terms FROM (SELECT DISTINCT frame_id FROM captions) f")
def caption_records(spark, sf):
    r = vocab.caption_records(fx.captions(spark, sf))
    return r.select("frame_id", F.size("captions").cast("bigint").alias("captions"), F.array_join("raw_terms", "|").alias("raw_terms"), F.array_join("normalized_terms", "|").alias("normalized_terms"))


def _rs_sql() -> str:
    hits = " UNION ALL ".join(rf"SELECT frame_id, caption_idx, 0 AS part, {i} AS i, '{t}' AS t FROM cl WHERE regexp_matches(c, '\b{t}s?\b')" for i, t in enumerate(CANONICAL))
    return rf"""{fx.CAPTIONS}, cl AS (SELECT frame_id, caption_idx, {clean_text_sql('text')} AS c FROM captions),
    sp AS (SELECT frame_id, caption_idx, string_split_regex(c, '[,;/\n]| and | with | plus ') AS l FROM cl), ch AS (SELECT frame_id, caption_idx, regexp_extract_all(c, '[a-z][a-z ]{{2,32}}') AS l FROM cl),
    cand AS ({hits} UNION ALL SELECT frame_id, caption_idx, 1, i, t FROM (SELECT frame_id, caption_idx, generate_subscripts(l, 1) AS i, trim(unnest(l)) AS t FROM sp) WHERE t <> '' AND len(string_split_regex(t, ' +')) BETWEEN 2 AND 4
    UNION ALL SELECT frame_id, caption_idx, 2, i, t FROM (SELECT frame_id, caption_idx, generate_subscripts(l, 1) AS i, trim(unnest(l)) AS t FROM ch) WHERE t <> '' AND len(string_split_regex(t, ' +')) BETWEEN 1 AND 3),
    normed AS (SELECT frame_id, caption_idx, part, i, {normalize_sql('t')} AS term FROM cand),
    once AS (SELECT frame_id, caption_idx, term, min(part * 1000 + i) AS o FROM normed WHERE term IS NOT NULL GROUP BY ALL),
    placed AS (SELECT frame_id, term, caption_idx * 100000 + row_number() OVER (PARTITION BY frame_id, caption_idx ORDER BY o) AS place FROM once),
    f AS (SELECT frame_id, term, count(*) AS freq, min(place) AS first FROM placed GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY freq DESC, first) AS rank FROM f)
    SELECT frame_id, term, freq, rank FROM r WHERE rank <= 12"""


@query(f"WITH {_rs_sql()}")
def rs_tags(spark, sf):
    return vocab.rs_tag_ranking(fx.captions(spark, sf))


def _prompt_sql() -> str:
    extra = {"building": ["building", "roof", "house"], "vehicle": ["vehicle", "car", "truck"], "road": ["road", "asphalt road", "street", "pavement"]}
    target: dict[str, list[str]] = {}
    for raw, mapped in SYNONYMS.items():
        target.setdefault(mapped, []).append(raw)
    table = {k: target.get(k, []) + extra.get(k, []) for k in {**target, **extra}}
    return "MAP {" + ", ".join(f"'{k}': [" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in table.items()) + "}"


@query(f"WITH {_WORDS}, n AS (SELECT x AS term, coalesce({normalize_sql('x', True)}, {clean_text_sql('x')}) AS norm FROM w), l AS (SELECT term, list_concat([norm], coalesce({_prompt_sql()}[norm], [])) AS l FROM n), u AS (SELECT term, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM l), o AS (SELECT term, p, min(i) AS i FROM u GROUP BY ALL) SELECT term, string_agg(p, '|' ORDER BY i) AS prompts FROM o GROUP BY term")
def prompts(spark, sf):
    p = vocab.build_prompts(_words(spark, sf).withColumnRenamed("x", "term"))
    return p.select("term", F.array_join("prompts", "|").alias("prompts"))


@query(rf"WITH l AS (SELECT p_partkey AS line_no, p_name || CASE WHEN p_partkey % 2 = 0 THEN ', ' ELSE ';' END || p_type || ',' || p_brand AS line FROM part), s AS (SELECT line_no, list_filter(list_transform(string_split_regex(line, '[,;]'), lambda x: trim(regexp_replace(regexp_replace(lower(x), '[_-]', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM l), r AS (SELECT p[1] AS name, line_no AS place, array_to_string(p, '|') AS prompts, row_number() OVER (PARTITION BY p[1] ORDER BY line_no) AS k FROM s) SELECT name, prompts, place FROM r WHERE k = 1")
def candidate_groups(spark, sf):
    sep = F.when(F.col("p_partkey") % 2 == 0, ", ").otherwise(";")
    lines = fx.load(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), F.concat("p_name", sep, "p_type", F.lit(","), "p_brand").alias("line"))
    return vocab.candidate_groups(lines).select("name", F.array_join("prompts", "|").alias("prompts"), "place")


@query(rf"WITH {fx.CAPTIONS}, t AS (SELECT frame_id, lower(string_agg(text, ' ' ORDER BY caption_idx)) AS t FROM captions GROUP BY ALL), n AS (SELECT unnest(['houses', 'red widget', 'parking', 'bolt', 'gear ', 'lot']) AS name) SELECT frame_id, name FROM t CROSS JOIN n WHERE regexp_matches(t, '\b' || name || '\b')")
def caption_term_match(spark, sf):
    names = spark.createDataFrame([(n,) for n in ("houses", "red widget", "parking", "bolt", "gear ", "lot")], "name string")
    return vocab.caption_matches(fx.captions(spark, sf), names)


_LISTS = "a AS (SELECT p_brand AS frame_id, p_name AS term, p_partkey AS pos FROM part WHERE p_size < 30), b AS (SELECT p_brand AS frame_id, p_name AS term, p_partkey AS pos FROM part WHERE p_size > 15)"


@query(f"WITH {_LISTS}, u AS (SELECT frame_id, term, 0 AS s, pos FROM a UNION ALL SELECT frame_id, term, 1, pos FROM b), m AS (SELECT frame_id, term, min((s, pos)) AS k FROM u GROUP BY ALL) SELECT frame_id, term, row_number() OVER (PARTITION BY frame_id ORDER BY k) - 1 AS pos FROM m")
def merge_terms(spark, sf):
    p = fx.load(spark, sf, "part").select(F.col("p_brand").alias("frame_id"), F.col("p_name").alias("term"), F.col("p_partkey").alias("pos"), "p_size")
    return vocab.merge_terms(p.where("p_size < 30").drop("p_size"), p.where("p_size > 15").drop("p_size"))


_KNOWN = sorted({*TERM_CLASSES, *PROMPT_GROUPS})
_LISTED = lambda names, place: "(" + " UNION ALL ".join(f"SELECT '{t}' AS term, {place} AS list, {i} AS pos" for i, t in enumerate(names)) + ")"


@query(rf"""WITH {_PHRASES}, own AS (SELECT frame_id, trim(regexp_replace(regexp_replace(lower(term), '[_-]', ' ', 'g'), '\s+', ' ', 'g')) AS term, 0 AS list, caption_idx * 100000 + pos AS pos FROM phrases),
known AS (SELECT * FROM own WHERE term IN {_in(_KNOWN)}), frames AS (SELECT DISTINCT frame_id FROM captions),
every AS (SELECT * FROM known UNION ALL SELECT frame_id, t.* FROM (SELECT * FROM frames ANTI JOIN known USING (frame_id)) CROSS JOIN {_LISTED(FALLBACK_TAGS, 1)} t UNION ALL SELECT frame_id, t.* FROM frames CROSS JOIN {_LISTED([t for t in CORE_TAGS if t in _KNOWN], 2)} t),
once AS (SELECT frame_id, term, min((list, pos)) AS p FROM every GROUP BY ALL), ranked_tags AS (SELECT frame_id, term, row_number() OVER (PARTITION BY frame_id ORDER BY p) AS rank FROM once)
SELECT frame_id, term, coalesce(MAP {{{', '.join(f"'{k}': '{'|'.join(v)}'" for k, v in PROMPT_GROUPS.items())}}}[term], term) AS prompts, rank FROM ranked_tags WHERE rank <= 20""")
def harvest_tags(spark, sf):
    c = fx.captions(spark, sf)
    tags = vocab.caption_phrases(c).select("frame_id", (F.col("caption_idx") * 100_000 + F.col("pos")).alias("pos"), "term")
    return vocab.harvest_tags(c.select("frame_id").distinct(), tags, 20).withColumn("prompts", F.array_join("prompts", "|"))


@query(f"WITH {_LISTS}, n AS (SELECT frame_id, term, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT frame_id, count(*) AS total FROM a GROUP BY ALL), c AS (SELECT DISTINCT frame_id, term FROM b) SELECT frame_id, term, {r6('coalesce(n, 0) / greatest(coalesce(total, 0), 1)')} AS caption_freq FROM c LEFT JOIN n USING (frame_id, term) LEFT JOIN t USING (frame_id)")
def caption_frequency(spark, sf):
    p = fx.load(spark, sf, "part").select(F.col("p_brand").alias("frame_id"), F.col("p_name").alias("term"), F.col("p_partkey").alias("pos"), "p_size")
    return rounded(vocab.caption_frequency(p.where("p_size < 30"), p.where("p_size > 15").select("frame_id", "term").distinct()), "caption_freq")


def _unit(c: str) -> str:
    return f"({c} - min({c}) OVER w) / greatest(max({c}) OVER w - min({c}) OVER w, 1e-6)"


_SCORED = f"""seen AS (SELECT frame_id, term, quantile_cont(score, 0.9) AS topp, avg(CASE WHEN score > 0.20 THEN 1 ELSE 0 END) AS area FROM ev WHERE valid GROUP BY ALL),
scored AS (SELECT frame_id, term, term_idx, 0.30 * {_unit('caption_freq')} + 0.25 * {_unit('presence')} + 0.35 * {_unit('topp')} + 0.10 * {_unit('area')} AS score FROM tt JOIN seen USING (frame_id, term) WINDOW w AS (PARTITION BY frame_id))"""


@query(f"WITH {fx.EVIDENCE}, {_EQ_TERMS}, {_SCORED} SELECT frame_id, term, term_idx, {r6('score')} AS score FROM scored")
def score_terms(spark, sf):
    ev = fx.evidence(spark, sf)
    return rounded(vocab.score_terms(ev, _term_table(ev)).select("frame_id", "term", "term_idx", "score"), "score")


@query(f"WITH {fx.EVIDENCE}, {_EQ_TERMS}, {_SCORED}, r AS (SELECT frame_id, term, term_idx, score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, term_idx) AS rank FROM scored) SELECT frame_id, term, {r6('score')} AS score, rank, score >= 0.45 AND rank <= 4 AS verified FROM r")
def verify_vocabulary(spark, sf):
    ev = fx.evidence(spark, sf)
    return rounded(vocab.verify_terms(vocab.score_terms(ev, _term_table(ev)), 4, 0.45).select("frame_id", "term", "score", "rank", "verified"), "score")


_VOC = "v AS (SELECT 'b' || (p_partkey % 13) AS frame_id, ['houses', 'Roof', 'cars', 'tree', 'lawn', 'street', 'river', 'fences', 'gizmo', 'terrain', 'shadow'][p_partkey * 7 % 11 + 1] AS term, p_partkey % 3 AS side FROM part)"
_EXP = "MAP {" + ", ".join(f"'{k}': [" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in GT_EXPANSION.items()) + "}"


def _vocabularies(spark, sf):
    names = F.array(*map(F.lit, ("houses", "Roof", "cars", "tree", "lawn", "street", "river", "fences", "gizmo", "terrain", "shadow")))
    v = fx.load(spark, sf, "part").select(F.concat(F.lit("b"), (F.col("p_partkey") % 13).cast("string")).alias("frame_id"), F.element_at(names, (F.col("p_partkey") * 7 % 11 + 1).cast("int")).alias("term"), (F.col("p_partkey") % 3).alias("side"), F.col("p_partkey").alias("pos"))
    return v.where("side = 0"), v.where("side > 0")


@query(f"""WITH {_VOC}, p AS (SELECT DISTINCT frame_id, {normalize_sql('term')} AS t FROM v WHERE side = 0 AND {normalize_sql('term')} IS NOT NULL), g AS (SELECT DISTINCT frame_id, {normalize_sql('term')} AS t FROM v WHERE side > 0 AND {normalize_sql('term')} IS NOT NULL),
x AS (SELECT DISTINCT frame_id, unnest(list_concat([t], coalesce({_EXP}[t], []))) AS t FROM g), n AS (SELECT frame_id, (SELECT count(*) FROM p WHERE p.frame_id = f.frame_id) AS n_pred, (SELECT count(*) FROM g WHERE g.frame_id = f.frame_id) AS n_gt, (SELECT count(*) FROM p JOIN x USING (frame_id, t) WHERE p.frame_id = f.frame_id) AS tp FROM (SELECT DISTINCT frame_id FROM v) f),
m AS (SELECT *, tp / greatest(n_pred, 1) AS precision, tp / greatest(n_gt, 1) AS recall FROM n) SELECT frame_id, n_pred, n_gt, tp, {r6s('precision', 'recall')}, {r6('2 * precision * recall / greatest(precision + recall, 1e-12)')} AS f1 FROM m""")
def vocabulary_prf(spark, sf):
    return rounded(vocab.vocabulary_prf(*_vocabularies(spark, sf)), "precision", "recall", "f1")


@query()
def fuzzy_similarity(spark, sf):
    return procedural.fuzzy_similarity(*_vocabularies(spark, sf))


@query(f"WITH {_VOC.replace('p_partkey % 3 AS side', 'p_partkey % 3 AS side, p_partkey AS pos')}, n AS (SELECT frame_id, count(DISTINCT term) AS n FROM v WHERE side = 0 GROUP BY ALL), c AS (SELECT frame_id, term, row_number() OVER (PARTITION BY frame_id ORDER BY pos) AS r FROM v WHERE side > 0) SELECT frame_id, term FROM c JOIN n USING (frame_id) WHERE r <= n + 1")
def proxy_truth(spark, sf):
    pred, cand = _vocabularies(spark, sf)
    return metrics.proxy_truth(cand, pred, extra=1)


@query("WITH s AS (SELECT conv_id, 'scene' || conv_id || ': ' || (turn + 1) || ', ' || (turn + 2) || ',' AS v FROM conversations) SELECT trim(string_split(v, ':')[1]) AS scene, trim(i)::INTEGER AS index FROM (SELECT v, unnest(string_split(string_split(v, ':')[2], ',')) AS i FROM s) WHERE trim(i) <> ''")
def frame_specs(spark, sf):
    from ..sources import readers

    c = fx.load(spark, sf, "conversations")
    n = lambda k: (F.col("turn") + k).cast("string")
    return readers.frame_specs(c.select(F.concat(F.lit("scene"), F.col("conv_id").cast("string"), F.lit(": "), n(1), F.lit(", "), n(2), F.lit(",")).alias("value")))


@query("SELECT p_brand AS sequence, p_type AS lidar_filename, max(p_partkey) AS p_partkey, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY ALL")
def manifest_last_wins(spark, sf):
    from ..sources import readers

    p = fx.load(spark, sf, "part").select(F.col("p_brand").alias("sequence"), F.col("p_type").alias("lidar_filename"), "p_partkey", "p_name")
    return readers.manifest_index(p, "p_partkey")
