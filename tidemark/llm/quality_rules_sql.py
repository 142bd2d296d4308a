"""DuckDB SQL for the quality rules."""

from tidemark.llm import quality_rules as q

_RATIO_SQL = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}
_SPACE = r"[\x20\x09-\x0D]"


def counts_sql(table: str) -> str:
    """CTEs `d` (the rows with rid, lang_, source_) and `counts` (rid and the base counts)."""
    return rf"""
d AS (SELECT *, coalesce(text, '') AS t, coalesce(lang, '') AS lang_, coalesce(source, '') AS source_,
             row_number() OVER () AS rid FROM {table}),
w AS (SELECT rid, u.word, u.i
      FROM (SELECT rid, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
           unnest(ws) WITH ORDINALITY AS u(word, i)),
wc AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS c
        FROM (SELECT rid, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3
              FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE w3 IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM tri, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_distinct
       FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (
  SELECT d.rid, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN wc ON wc.rid = d.rid LEFT JOIN rep ON rep.rid = d.rid LEFT JOIN ln ON ln.rid = d.rid),
judged AS (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counts JOIN d USING (rid))"""


def verdict_sql(table: str) -> str:
    """CTEs up to `verdict`: the rows of `judged` with kept."""
    ratios = " UNION ALL ".join(f"SELECT lang_, source_, '{r}' AS ratio, ({x})::DOUBLE AS x FROM judged WHERE NOT base_failed" for r, x in _RATIO_SQL.items())
    floors = " ".join(f"WHEN '{r}' THEN {floor}" for r, floor in q.RATIOS.items())
    gamma = f"{q._GAMMA!r}::DOUBLE"

    def limits(name: str, by: str) -> str:
        return f"""
{name} AS (
  SELECT {by}, ratio, max(total) AS n, min(q2) - greatest({q.FENCE} * (min(q3) - min(q1)), CASE ratio {floors} END) AS lo,
         min(q2) + greatest({q.FENCE} * (min(q3) - min(q1)), CASE ratio {floors} END) AS hi
  FROM (SELECT {by}, ratio, total, CASE WHEN upto > floor(0.25 * (total - 1)) THEN value END AS q1,
               CASE WHEN upto > floor(0.5 * (total - 1)) THEN value END AS q2,
               CASE WHEN upto > floor(0.75 * (total - 1)) THEN value END AS q3
        FROM (SELECT {by}, ratio, CASE WHEN bin IS NULL THEN 0 ELSE 2 * pow({gamma}, bin) / (1 + {gamma}) END AS value,
                     sum(n) OVER (PARTITION BY {by}, ratio ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {by}, ratio) AS total
              FROM (SELECT {by}, ratio, bin, count(*) AS n FROM bins GROUP BY ALL)))
  GROUP BY {by}, ratio)"""

    tests = []
    for r, x in _RATIO_SQL.items():
        for side, op in (("hi", "<="), *([("lo", ">=")] if r in q.TWO_SIDED else [])):
            own = f"FROM own WHERE ratio = '{r}' AND own.lang_ = j.lang_ AND own.source_ = j.source_"
            lang = f"FROM of_lang WHERE ratio = '{r}' AND of_lang.lang_ = j.lang_"
            tests.append(
                f"({x})::DOUBLE {op} CASE WHEN (SELECT n {own}) >= {q.MIN_GROUP} THEN (SELECT {side} {own}) "
                f"WHEN (SELECT n {lang}) >= {q.MIN_GROUP} THEN (SELECT {side} {lang}) "
                f"ELSE (SELECT {side} FROM of_all WHERE ratio = '{r}') END"
            )
    return f"""{counts_sql(table)},
ratios AS ({ratios}),
bins AS (SELECT lang_, source_, 1 AS one_, ratio, CASE WHEN x <= 0 THEN NULL ELSE ceil(ln(x) / {q.math.log(q._GAMMA)!r}::DOUBLE) END AS bin FROM ratios),
{limits('own', 'lang_, source_')},
{limits('of_lang', 'lang_')},
{limits('of_all', 'one_')},
verdict AS (SELECT *, NOT base_failed AND coalesce({' AND '.join(tests)}, false) AS kept FROM judged j)"""


OP10_SQL = f"WITH {verdict_sql('documents')} SELECT doc_id, {', '.join(q.BASE)}, base_failed, kept FROM verdict"
