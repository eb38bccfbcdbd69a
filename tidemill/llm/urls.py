"""URL filter: rules by host and path, else a character language-model ratio.

Two variable-order Markov models over characters, one of accepted and one of rejected URLs, share an alphabet of 33
symbols (letters, a digit sign, ``. / - ?``, start and end marks). Each predicts a character from up to three before it,
smoothed by Witten-Bell interpolation down to shorter contexts. A URL's score is the difference of its log-likelihoods
divided by its length; the threshold is calibrated on labelled URLs by balanced accuracy over bins of scores.

Rejected are URLs whose host holds a term of a list; accepted is the background: all others but those that a rule blocks.
What the rules decide by is no evidence for other URLs, so top-level domains, host labels and path segments that rules
name are taken out of the models' texts. Sites, by the last host label that is left, are dealt to ``FOLDS`` folds, and a
URL is scored by the models of the other folds, both to calibrate and to judge: a site is never accepted because it was
counted itself. Different texts count once each, so that a host that is a third of all rows doesn't drown the others.

Everything is counted over all rows, in built-in functions only; weights are whole millionths, so sums don't depend on
their order. Model tables have at most 33 ** 4 rows whatever the input, and so are broadcast. Equal texts are scored once;
a URL that is a third of all rows is one row before it is cut into characters, and its rows meet their score in a join of
checkpointed verdicts, which may split hot keys.

A null URL, or one without ``://``, has an empty host and path and no rule; its verdict is the method's for the empty
string. Repeated rows stay. Without labels of both kinds the threshold allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BAD_TERMS = ("casino", "bets", "betting", "pills", "adult", "porn", "xxx", "ads-", "track", "viagra", "poker", "lottery", "warez", "torrent", "payday")
ORDER, SYMBOLS, BINS, BIN_LIMIT, FOLDS, UNIT, SLACK = 4, 33, 200, 2000, 4, 1_000_000, 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host, A-Z lower-cased, and the path without query or fragment."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith(f".{text[:at]}")) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def named_parts(rules=RULES) -> tuple[list[str], list[str]]:
    """The host labels and the path segments that rules name."""
    hosts, paths = zip(*((text[: text.index("/")], text[text.index("/") :]) for _, text in rules), strict=True) if rules else ((), ())
    return sorted({x for h in hosts for x in h.split(".")}), sorted({x for p in paths for x in p.split("/") if x and not x.isdigit()})


def normal(host: Column, path: Column, rules=RULES) -> Column:
    """Host and path in the models' alphabet, without the top-level domain and what the rules name."""
    labels, segments = named_parts(rules)
    left = F.filter(F.slice(F.split(host, "[.]"), 1, F.size(F.split(host, "[.]")) - 1), lambda x: ~x.isin(labels))
    bare = F.concat(F.array_join(left, "."), F.array_join(F.filter(F.split(path, "/"), lambda x: ~x.isin(segments)), "/"))
    return F.regexp_replace(F.regexp_replace(F.translate(bare, UPPER, LOWER), "[0-9]", "0"), "[^a-z0./-]", "?")


def fold_of(norm: Column) -> Column:
    """The fold of a text's site, from the letters of its last host label."""
    site = F.regexp_extract(norm, "^([^/]*[.])?([^/.]*)", 2)
    return F.conv(F.substring(F.md5(site), 1, 4), 16, 10).cast("int") % FOLDS


def grams(text: Column) -> Column:
    """All windows of ORDER symbols of the marked text: one for each symbol and one for the end."""
    marked = F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(marked, i, F.lit(ORDER)))


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, w0, w1, ...): log of the two models' probabilities' ratio for each fold, in parts of ``UNIT``.

    ``counts``: (gram, fold, a, r) for each gram and each fold, counted over the other folds.
    """
    found = counts.select("gram", "fold")
    pa = pr = F.lit(1.0 / SYMBOLS)
    for k in range(1, ORDER + 1):
        tail, context = F.substring("gram", ORDER - k + 1, k), F.substring("gram", ORDER - k + 1, k - 1)
        ending = counts.groupBy(tail.alias("tail"), "fold").agg(F.sum("a").alias(f"a{k}"), F.sum("r").alias(f"r{k}"))
        after = ending.groupBy(F.substring("tail", 1, k - 1).alias("context"), "fold").agg(
            F.sum(f"a{k}").alias(f"na{k}"), F.sum(f"r{k}").alias(f"nr{k}"), F.count_if(F.col(f"a{k}") > 0).alias(f"ta{k}"), F.count_if(F.col(f"r{k}") > 0).alias(f"tr{k}")
        )
        found = found.withColumn("tail", tail).join(ending, ["tail", "fold"]).drop("tail")
        found = found.withColumn("context", context).join(after, ["context", "fold"]).drop("context")
        found = found.withColumn(f"pa{k}", _smoothed(f"a{k}", f"na{k}", f"ta{k}", pa)).withColumn(f"pr{k}", _smoothed(f"r{k}", f"nr{k}", f"tr{k}", pr))
        pa, pr = F.col(f"pa{k}"), F.col(f"pr{k}")
    weight = F.round(F.ln(pa) * UNIT - F.ln(pr) * UNIT).cast("long")
    return found.groupBy("gram").agg(*[F.max(F.when(F.col("fold") == f, weight)).alias(f"w{f}") for f in range(FOLDS)])


def _smoothed(n: str, total: str, kinds: str, lower: Column) -> Column:
    return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * lower) / (F.col(total) + F.col(kinds))).otherwise(lower)


def threshold(scored: DataFrame) -> int:
    """The bin from which scores are accepted: the middle of those whose balanced accuracy on labels (a, r) is the best or
    at most 1 / ``SLACK`` less. The background holds a few URLs that ought to be rejected, so the very best would yield to them.
    """
    rows = scored.where("a + r > 0").groupBy("bin").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).orderBy("bin").collect()
    all_a, all_r = sum(x.a for x in rows), sum(x.r for x in rows)
    found, below_a, below_r, last = [], 0, 0, None
    for x in rows:  # at most 2 * BIN_LIMIT + 1
        found.append(((all_a - below_a) * all_r + below_r * all_a, x.bin if last is None else last, x.bin))
        below_a, below_r, last = below_a + x.a, below_r + x.r, x.bin
    best = max((v for v, _, _ in found), default=0)
    if not all_a or not all_r or best <= all_a * all_r:
        return -BIN_LIMIT
    good = [(low, high) for v, low, high in found if v * SLACK >= best * SLACK - all_a * all_r]
    return -(-(good[0][0] + good[-1][1]) // 2)


def score(texts: DataFrame) -> DataFrame:
    """Add bin, the binned score, to distinct ``texts`` (norm, a, r: whether accepted or rejected, as 0 or 1)."""
    cut = texts.select("norm", "a", "r", fold_of(F.col("norm")).alias("fold"), F.explode(grams(F.col("norm"))).alias("gram"))
    others = lambda c, f: F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0))
    counted = cut.groupBy("gram").agg(*[others(c, f).alias(f"{c}{f}") for f in range(FOLDS) for c in "ar"])
    counts = checkpointed(counted.select("gram", F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"a{f}").alias("a"), F.col(f"r{f}").alias("r")) for f in range(FOLDS)])).alias("x")).select("gram", "x.*"))
    model = checkpointed(ratios(counts))
    own = F.get(F.array(*[f"w{f}" for f in range(FOLDS)]), F.col("fold"))
    summed = cut.join(F.broadcast(model), "gram").groupBy("norm", "a", "r").agg(F.sum(own).alias("total"), F.count("*").alias("n"))
    return summed.withColumn("bin", F.least(F.greatest(F.floor(F.col("total") * BINS / (F.col("n") * UNIT)), F.lit(-BIN_LIMIT)), F.lit(BIN_LIMIT)).cast("int"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, bad_terms=BAD_TERMS) -> DataFrame:
    """One row per page: id, host, path, rule (or null), verdict (allow or block)."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    bad = F.col("host").rlike("|".join(t.replace(".", r"\.") for t in bad_terms))
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), normal(F.col("host"), F.col("path"), rules).alias("norm"), bad.alias("bad"))
    accepted = ~F.col("bad") & ~F.coalesce(F.col("ruled") == "block", F.lit(False)) & (F.col("norm") != "")
    texts = checkpointed(rows.groupBy("norm").agg(F.max(accepted.cast("int")).alias("a"), F.max(F.col("bad").cast("int")).alias("r")))
    scored = checkpointed(score(texts).select("norm", "a", "r", "bin"))
    least = threshold(scored)
    verdicts = checkpointed(scored.select("norm", F.when(F.col("bin") >= least, "allow").otherwise("block").alias("judged")))
    return rows.join(verdicts, "norm").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"))


def oracle() -> str:
    """DuckDB SQL for ``judge`` of the pages table."""
    upper, rule_cases, verdict_cases = f"'{UPPER}', '{LOWER}'", [], []
    for kind, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        fits = f"(host = '{text[:at]}' OR ends_with(host, '.{text[:at]}')) AND starts_with(path, '{text[at:]}')"
        rule_cases.append(f"WHEN {fits} THEN '{text}'")
        verdict_cases.append(f"WHEN {fits} THEN '{kind}'")
    labels, segments = ("(" + ", ".join(f"'{x}'" for x in xs) + ")" for xs in named_parts())
    steps, pa, pr = [], f"1.0::DOUBLE / {SYMBOLS}", f"1.0::DOUBLE / {SYMBOLS}"
    previous = "(SELECT gram, fold FROM counts)"
    for k in range(1, ORDER + 1):
        tail, context = f"substr(gram, {ORDER - k + 1}, {k})", f"substr(gram, {ORDER - k + 1}, {k - 1})"
        steps.append(f"c{k} AS (SELECT {tail} AS tail, fold, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1, 2)")
        steps.append(f"x{k} AS (SELECT substr(tail, 1, {k - 1}) AS context, fold, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM c{k} GROUP BY 1, 2)")
        if k > 1:
            pa, pr = f"p{k - 1}.pa", f"p{k - 1}.pr"
        source = f"{previous} s" if k == 1 else f"p{k - 1}"
        name = "s" if k == 1 else f"p{k - 1}"
        steps.append(
            f"p{k} AS (SELECT {name}.gram, {name}.fold, CASE WHEN x.na > 0 THEN (c.a + x.ta * {pa}) / (x.na + x.ta) ELSE {pa} END AS pa, CASE WHEN x.nr > 0 THEN (c.r + x.tr * {pr}) / (x.nr + x.tr) ELSE {pr} END AS pr"
            f" FROM {source} JOIN c{k} c ON c.tail = {tail.replace('gram', name + '.gram')} AND c.fold = {name}.fold JOIN x{k} x ON x.context = {context.replace('gram', name + '.gram')} AND x.fold = {name}.fold)"
        )
    return f"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), {upper}) AS host,
  regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
split AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS segments FROM parts),
ruled AS (SELECT page_id, host, path, CASE {" ".join(rule_cases)} END AS rule, CASE {" ".join(verdict_cases)} END AS ruled,
  regexp_replace(regexp_replace(translate(array_to_string(list_filter(labels[:len(labels) - 1], lambda x: x NOT IN {labels}), '.') || array_to_string(list_filter(segments, lambda x: x NOT IN {segments}), '/'), {upper}), '[0-9]', '0', 'g'), '[^a-z0./-]', '?', 'g') AS norm,
  regexp_matches(host, '{"|".join(BAD_TERMS)}') AS bad FROM split),
texts AS (SELECT norm, max((NOT bad AND NOT coalesce(ruled = 'block', false) AND norm <> '')::INT) AS a, max(bad::INT) AS r FROM ruled GROUP BY norm),
cut AS (SELECT norm, a, r, ('0x' || substr(md5(regexp_extract(norm, '^([^/]*[.])?([^/.]*)', 2)), 1, 4))::INT % {FOLDS} AS fold,
  substr('{"^" * (ORDER - 1)}' || norm || '$', i, {ORDER}) AS gram FROM (SELECT *, unnest(range(1, length(norm) + 2)) AS i FROM texts)),
counts AS (SELECT gram, f.fold, coalesce(sum(a) FILTER (cut.fold <> f.fold), 0) AS a, coalesce(sum(r) FILTER (cut.fold <> f.fold), 0) AS r FROM cut, range({FOLDS}) f(fold) GROUP BY ALL),
{", ".join(steps)},
scored AS (SELECT norm, a, r, least(greatest(floor(sum(round(ln(pa) * {UNIT} - ln(pr) * {UNIT})::BIGINT) * {BINS} / (count(*) * {UNIT})), -{BIN_LIMIT}), {BIN_LIMIT})::INT AS bin
  FROM cut JOIN p{ORDER} USING (gram, fold) GROUP BY norm, a, r),
bins AS (SELECT bin, sum(a) AS a, sum(r) AS r FROM scored WHERE a + r > 0 GROUP BY bin),
sums AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin), bin) AS low, coalesce(sum(a) OVER w, 0) AS below_a, coalesce(sum(r) OVER w, 0) AS below_r, sum(a) OVER () AS all_a, sum(r) OVER () AS all_r
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
valued AS (SELECT *, (all_a - below_a) * all_r + below_r * all_a AS v FROM sums WHERE all_a > 0 AND all_r > 0),
cutoff AS (SELECT coalesce((SELECT ceil((min(low) + max(bin)) / 2.0)::INT FROM valued, (SELECT max(v) AS best FROM valued)
  WHERE best > all_a * all_r AND v * {SLACK} >= best * {SLACK} - all_a * all_r), -{BIN_LIMIT}) AS least)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bin >= least THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scored USING (norm), cutoff"""
