"""DuckDB SQL for the oracle check: the same chain as ``plans.baseline`` written as CTEs.

Only used to produce ``oracle_sql()`` strings; Spark never runs these.
"""

from __future__ import annotations

from termlens.config import DEFAULT_TASKS, TaskMap
from termlens.functions.stopwords import LANGUAGES_WITH_STOPWORDS, stopwords_for, sql_list
from termlens.sources.tables import split_sql

WORD_RE = r"[\p{L}\p{N}_]{2,}"


def _ngram_sql(w: str, n: int) -> str:
    return f"[array_to_string(list_slice({w}, i, i + {n - 1}), ' ') FOR i IN range(1, len({w}) - {n - 2})]"


def stopword_filter_sql(w: str, lang: str) -> str:
    cases = " ".join(
        f"WHEN {lang} = '{code}' THEN list_filter({w}, lambda t: NOT list_contains([{sql_list(stopwords_for(code))}], t))"
        for code in LANGUAGES_WITH_STOPWORDS)
    return f"CASE {cases} ELSE {w} END"


def class_values(tasks: TaskMap) -> str:
    rows = ", ".join(f"('{t}', {c})" for t, n in tasks.tasks for c in range(n))
    return f"(SELECT task, CAST(class AS INTEGER) AS class FROM (VALUES {rows}) v(task, class))"


def labels_long_sql(tasks: TaskMap, src: str = "samples") -> str:
    return " UNION ALL ".join(f"SELECT _id, '{t}' AS task, CAST({t} AS INTEGER) AS label FROM {src}"
                              for t in tasks.names)


def samples_cte(tasks: TaskMap = DEFAULT_TASKS) -> str:
    tcols = ", ".join(f"CAST(l.{t} AS INTEGER) AS {t}" for t in tasks.names)
    return (f"samples AS (SELECT d.doc_id AS _id, d.text, d.lang, {tcols}, {split_sql('d.doc_id')} AS split "
            f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL)")


def baseline_ctes(tasks: TaskMap = DEFAULT_TASKS, min_df: int = 2, max_df: float = 0.3) -> list[str]:
    """CTEs: samples, words, terms, tf, train, ndocs, vocab, x, labels_long, classes, lt, stats,
    coefm, coef, bias, scores, preds, attrs (all splits, with ``split``)."""
    grams = " , ".join(_ngram_sql("w", n) for n in (1, 2, 3))
    return [
        samples_cte(tasks),
        f"words AS (SELECT _id, {stopword_filter_sql('w0', 'lang')} AS w FROM "
        f"(SELECT _id, lang, regexp_extract_all(lower(text), '{WORD_RE}') AS w0 FROM samples))",
        f"terms AS (SELECT _id, unnest(list_concat({grams})) AS term FROM words)",
        "tf AS (SELECT _id, term, count(*) AS tf FROM terms GROUP BY _id, term)",
        "train AS (SELECT _id FROM samples WHERE split = 'train')",
        "ndocs AS (SELECT count(*) AS n_docs FROM train)",
        "dfs AS (SELECT term, count(*) AS df FROM tf WHERE _id IN (SELECT _id FROM train) GROUP BY term)",
        f"vocab AS (SELECT term, df, ln(CAST(n_docs + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + 1 AS idf "
        f"FROM dfs, ndocs WHERE df >= {min_df} AND df <= CAST({max_df} AS DOUBLE) * n_docs)",
        "raw AS (SELECT tf._id, tf.term, tf.tf * vocab.idf AS v FROM tf JOIN vocab ON tf.term = vocab.term)",
        "x AS (SELECT _id, term, v / sqrt(sum(v * v) OVER (PARTITION BY _id)) AS x FROM raw)",
        f"labels_long AS ({labels_long_sql(tasks)})",
        f"classes AS {class_values(tasks)}",
        "lt AS (SELECT l.* FROM labels_long l WHERE l._id IN (SELECT _id FROM train))",
        "stats AS (SELECT c.task, c.class, coalesce(k.n_class, 0) AS n_class, coalesce(tt.n_total, 0) AS n_total "
        "FROM classes c LEFT JOIN (SELECT task, label, count(*) AS n_class FROM lt GROUP BY task, label) k "
        "ON c.task = k.task AND c.class = k.label "
        "LEFT JOIN (SELECT task, count(*) AS n_total FROM lt GROUP BY task) tt ON c.task = tt.task)",
        "xt AS (SELECT * FROM x WHERE _id IN (SELECT _id FROM train))",
        "per_class AS (SELECT xt.term, lt.task, lt.label, sum(xt.x) AS s FROM xt JOIN lt ON xt._id = lt._id "
        "GROUP BY xt.term, lt.task, lt.label)",
        "totals AS (SELECT term, sum(x) AS t FROM xt GROUP BY term)",
        "coefm AS (SELECT g.term, st.task, st.class, "
        "coalesce(coalesce(pc.s, 0) / CAST(NULLIF(st.n_class, 0) AS DOUBLE), 0) AS mu_c, "
        "coalesce((g.t - coalesce(pc.s, 0)) / CAST(NULLIF(st.n_total - st.n_class, 0) AS DOUBLE), 0) AS mu_r "
        "FROM totals g CROSS JOIN stats st LEFT JOIN per_class pc "
        "ON pc.term = g.term AND pc.task = st.task AND pc.label = st.class)",
        "coef AS (SELECT term, task, class, mu_c - mu_r AS w FROM coefm)",
        "bias AS (SELECT task, class, CAST(-0.5 AS DOUBLE) * sum(mu_c * mu_c - mu_r * mu_r) AS b "
        "FROM coefm GROUP BY task, class)",
        "dots AS (SELECT x._id, c.task, c.class, sum(x.x * c.w) AS dot FROM x JOIN coef c ON x.term = c.term "
        "GROUP BY x._id, c.task, c.class)",
        "scores AS (SELECT s._id, cl.task, cl.class, round(coalesce(d.dot, 0) + b.b, 9) AS score "
        "FROM samples s CROSS JOIN classes cl "
        "LEFT JOIN dots d ON d._id = s._id AND d.task = cl.task AND d.class = cl.class "
        "JOIN bias b ON b.task = cl.task AND b.class = cl.class)",
        "preds AS (SELECT l._id, l.task, l.label, p.class AS pred FROM labels_long l JOIN "
        "(SELECT _id, task, class FROM (SELECT *, row_number() OVER (PARTITION BY _id, task "
        "ORDER BY score DESC, class ASC) AS rn FROM scores) WHERE rn = 1) p "
        "ON l._id = p._id AND l.task = p.task)",
        "attrs AS (SELECT x._id, p.task, x.term, x.x * c.w AS attr, p.pred, p.label, p.pred AS index, "
        "CAST(len(string_split(x.term, ' ')) AS VARCHAR) || 'gram' AS type, s.split "
        "FROM x JOIN preds p ON x._id = p._id "
        "JOIN coef c ON c.term = x.term AND c.task = p.task AND c.class = p.pred "
        "JOIN samples s ON s._id = x._id WHERE x.x * c.w <> 0)",
    ]


def level1_cte(src: str = "attrs", split: str | None = "test", positive_only: bool = True,
               type_: str = "!sentence") -> str:
    conds = ["NOT regexp_matches(task, '=|-')"]
    if split is not None:
        conds.append(f"split = '{split}'")
    conds.append(f"type <> '{type_[1:]}'" if type_.startswith("!") else f"type = '{type_}'")
    if positive_only:
        conds.append("attr >= 0")
    return (f"level1 AS (SELECT lower(term) AS term, type, attr >= 0 AS pos, index, label, pred, task, "
            f"sum(abs(attr)) AS attr, count(*) AS occurance FROM {src} WHERE {' AND '.join(conds)} "
            f"GROUP BY lower(term), type, attr >= 0, index, label, pred, task)")


def avg_cte(over, name: str = "agg", src: str = "level1") -> str:
    keys = ", ".join(["term", *over])
    return (f"{name} AS (SELECT {keys}, round(sum(abs(attr)) / sum(occurance), 9) AS attr, "
            f"CAST(sum(occurance) AS BIGINT) AS occurance FROM {src} WHERE abs(attr) > CAST(1e-5 AS DOUBLE) "
            f"GROUP BY {keys})")


def sum_sqrt_cte(over, name: str = "agg", src: str = "level1") -> str:
    keys = ", ".join(["term", *over])
    return (f"{name} AS (SELECT {keys}, round(sqrt(sum(abs(attr))), 9) AS attr, "
            f"CAST(sum(occurance) AS BIGINT) AS occurance FROM {src} GROUP BY {keys})")


def homogeneity_ctes(over, name: str = "agg", src: str = "level1") -> list[str]:
    keys = ", ".join(["term", *over])
    return [
        f"hs AS (SELECT {keys}, sqrt(sum(abs(attr))) AS score, CAST(sum(occurance) AS BIGINT) AS occurance "
        f"FROM {src} GROUP BY {keys})",
        "htot AS (SELECT term, sum(abs(score)) AS tot FROM hs GROUP BY term)",
        "hshare AS (SELECT hs.term, CASE WHEN tot = 0 THEN NULL ELSE score / tot END AS p "
        "FROM hs JOIN htot ON hs.term = htot.term)",
        "hent AS (SELECT term, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM hshare GROUP BY term)",
        "hmm AS (SELECT min(h) AS hmin, max(h) AS hmax FROM hent)",
        "hw AS (SELECT term, CASE WHEN hmax > hmin THEN 1 - (h - hmin) / (hmax - hmin) ELSE 1.0 END AS wgt "
        "FROM hent, hmm)",
        f"{name} AS (SELECT {', '.join('hs.' + k for k in ['term', *over])}, round(score * wgt, 9) AS attr, "
        f"occurance FROM hs JOIN hw ON hs.term = hw.term)",
    ]


def top_sql(over, k: int, src: str = "agg") -> str:
    keys = ", ".join(["term", *over])
    part = ", ".join(over)
    return (f"SELECT {keys}, attr, occurance FROM (SELECT *, row_number() OVER (PARTITION BY {part} "
            f"ORDER BY attr DESC, term ASC) AS rn FROM {src}) WHERE rn <= {k}")


def exclusive_top_sql(over, k: int, src: str = "agg") -> str:
    order = ", ".join(f"{o} ASC" for o in over)
    return (f"SELECT * FROM ({top_sql(over, k, '(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY attr DESC, ' + order + ') AS r1 FROM ' + src + ') WHERE r1 = 1)')})")


def with_(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


# ---- text ------------------------------------------------------------------------------------------
LINE_RE = r"\n|<\s*?br\s*?/\s*?>"


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD_RE}')"


def ngrams_sql(w: str) -> str:
    return "list_concat(" + ", ".join(_ngram_sql(w, n) for n in (1, 2, 3)) + ")"


def sentence_split_sql(text: str) -> str:
    pieces = (f"flatten(list_transform(regexp_split_to_array({text}, '{LINE_RE}'), lambda ln: "
              f"string_split(regexp_replace(ln, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))))")
    return f"list_filter(list_transform({pieces}, lambda s: trim(s)), lambda s: s <> '')"


def windows_sql(tokens: str, size: int, overlap: int) -> str:
    step = size - overlap
    cnt = (f"(CASE WHEN len({tokens}) <= {size} THEN 1 ELSE 1 + CAST(ceil((len({tokens}) - {size}) / "
           f"CAST({step} AS DOUBLE)) AS INTEGER) END)")
    return (f"(CASE WHEN len({tokens}) = 0 THEN [] ELSE list_transform(range(0, {cnt}), lambda k: "
            f"array_to_string(list_slice({tokens}, 1 + k * {step}, k * {step} + {size}), ' ')) END)")


CLEAN_PUNCT_SQL = "([.,!?()])"


def ig_ctes(split: str, n_steps: int | None, prefix: str = "", target: str = "pred") -> list[str]:
    """Softmax-linear integrated gradients (``n_steps`` midpoints) or LGXA (``None``: alpha = 1) of the class ``target``."""
    steps = (f"SELECT (CAST(i AS DOUBLE) + 0.5) / {n_steps} AS a FROM range(0, {n_steps}) t(i)" if n_steps
             else "SELECT CAST(1.0 AS DOUBLE) AS a")
    P = prefix
    out = [
        f"{P}tx AS (SELECT * FROM x WHERE _id IN (SELECT _id FROM samples WHERE split = '{split}'))",
        "{P}tdots AS (SELECT {P}tx._id, c.task, c.class, sum({P}tx.x * c.w) AS dot FROM {P}tx JOIN coef c ON {P}tx.term = c.term "
        "GROUP BY {P}tx._id, c.task, c.class)",
        "{P}grid AS (SELECT s._id, cl.task, cl.class, coalesce(d.dot, 0) AS dot, b.b FROM samples s CROSS JOIN classes cl "
        "LEFT JOIN {P}tdots d ON d._id = s._id AND d.task = cl.task AND d.class = cl.class "
        f"JOIN bias b ON b.task = cl.task AND b.class = cl.class WHERE s.split = '{split}')",
        f"{P}steps AS ({steps})",
        "{P}lg AS (SELECT g._id, g.task, g.class, st.a, st.a * g.dot + g.b AS z FROM {P}grid g CROSS JOIN {P}steps st)",
        "{P}lg2 AS (SELECT *, exp(z - max(z) OVER (PARTITION BY _id, task, a)) AS ex FROM {P}lg)",
        "{P}pr AS (SELECT _id, task, class, a, ex / sum(ex) OVER (PARTITION BY _id, task, a) AS p FROM {P}lg2)",
        f"{P}pc AS (SELECT pr._id, pr.task, pr.a, pr.p AS pc, pd.{target} AS pred FROM {P}pr pr JOIN preds pd "
        f"ON pd._id = pr._id AND pd.task = pr.task AND pd.{target} = pr.class)",
        "{P}mw AS (SELECT pr._id, pr.task, pr.class, avg(CASE WHEN pr.class = pc.pred THEN pc.pc * (1 - pc.pc) "
        "ELSE -pc.pc * pr.p END) AS m FROM {P}pr pr JOIN {P}pc pc ON pc._id = pr._id AND pc.task = pr.task AND pc.a = pr.a "
        "GROUP BY pr._id, pr.task, pr.class)",
        "{P}igt AS (SELECT {P}tx._id, mw.task, {P}tx.term, sum(mw.m * {P}tx.x * c.w) AS attr FROM {P}tx JOIN {P}mw mw ON mw._id = {P}tx._id "
        "JOIN coef c ON c.term = {P}tx.term AND c.task = mw.task AND c.class = mw.class GROUP BY {P}tx._id, mw.task, {P}tx.term)",
        "{P}ig AS (SELECT igt._id, igt.task, igt.term, igt.attr, p.pred, p.label, p.pred AS index, "
        "CAST(len(string_split(igt.term, ' ')) AS VARCHAR) || 'gram' AS type FROM {P}igt igt JOIN preds p "
        "ON p._id = igt._id AND p.task = igt.task)",
    ]
    return [c.replace('{P}', P) for c in out]


def tokens_cte(split: str | None = None) -> str:
    where = f" WHERE _id IN (SELECT _id FROM samples WHERE split = '{split}')" if split else ""
    return (f"tokens AS (SELECT _id, CAST(unnest(range(0, len(w))) AS INTEGER) AS pos, unnest(w) AS token "
            f"FROM words{where})")


def random_attr_sql(seed: int = 0) -> str:
    return (f"CAST(('0x' || substr(md5(CAST(_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':{seed}'), 1, 8))"
            f"::BIGINT AS DOUBLE) / 4294967296.0")


def removal_ctes(tasks, split: str = "eval", methods=("lrp", "ig", "lgxa", "random")) -> list[str]:
    from termlens.operators.masking import PERCENTILES

    grams = ", ".join(
        f"[{{'start': i - 1, 'n': {n}, 'term': array_to_string(list_slice(w, i, i + {n - 1}), ' ')}} "
        f"FOR i IN range(1, len(w) - {n - 2})]" for n in (1, 2, 3))
    ta = []
    ctes = []
    if "lrp" in methods:
        ta.append("SELECT 'lrp' AS method, x._id, p.task, x.term, x.x * c.w AS attr FROM x JOIN preds p ON p._id = x._id "
                  "JOIN coef c ON c.term = x.term AND c.task = p.task AND c.class = p.label JOIN samples s ON s._id = x._id "
                  f"WHERE s.split = '{split}' AND x.x * c.w <> 0")
    for name, steps in (("ig", 20), ("lgxa", None)):
        if name in methods:
            ctes += ig_ctes(split, steps, f"{name}_", "label")
            ta.append(f"SELECT '{name}' AS method, _id, task, term, attr FROM {name}_ig")
    pts = ", ".join(f"({p})" for p in [0] + PERCENTILES)
    mvals = ", ".join(f"('{m}')" for m in methods)
    rnd = random_attr_sql(0)
    ctes += [
        f"ew AS (SELECT _id, w FROM words WHERE _id IN (SELECT _id FROM samples WHERE split = '{split}'))",
        f"occ AS (SELECT _id, o.start AS start, o.n AS n, o.term AS term FROM "
        f"(SELECT _id, unnest(list_concat({grams})) AS o FROM ew))",
        "occv AS (SELECT occ.*, v.idf FROM occ JOIN vocab v ON v.term = occ.term)",
        "dlen AS (SELECT _id, CAST(len(w) AS INTEGER) AS n_tokens FROM ew)",
        "etok AS (SELECT _id, CAST(unnest(range(0, len(w))) AS INTEGER) AS pos FROM ew)",
        f"mt AS (SELECT m.method, t.task FROM (VALUES {mvals}) m(method) CROSS JOIN "
        f"(SELECT DISTINCT task FROM classes) t)",
        "tgrid AS (SELECT mt.method, etok._id, mt.task, etok.pos FROM etok CROSS JOIN mt)",
        "ta AS (" + " UNION ALL ".join(ta) + ")" if ta else "ta AS (SELECT NULL AS method WHERE false)",
        "tfo AS (SELECT _id, term, count(*) AS tf FROM occv GROUP BY _id, term)",
        "share AS (SELECT ta.method, ta._id, ta.task, ta.term, ta.attr / tfo.tf AS a FROM ta JOIN tfo "
        "ON tfo._id = ta._id AND tfo.term = ta.term)",
        "cov AS (SELECT _id, start, n, term, unnest(range(start, start + n)) AS pos FROM occv)",
        "rel AS (SELECT sh.method, cov._id, sh.task, cov.pos, sum(sh.a / cov.n) AS r FROM cov JOIN share sh "
        "ON sh._id = cov._id AND sh.term = cov.term GROUP BY sh.method, cov._id, sh.task, cov.pos "
        f"UNION ALL SELECT method, _id, task, pos, {rnd} AS r FROM tgrid WHERE method = 'random')",
        "rk AS (SELECT g.method, g._id, g.task, g.pos, row_number() OVER (PARTITION BY g.method, g._id, g.task "
        "ORDER BY round(coalesce(r.r, 0), 9) DESC, g.pos ASC) AS rank FROM tgrid g LEFT JOIN rel r "
        "ON r.method = g.method AND r._id = g._id AND r.task = g.task AND r.pos = g.pos)",
        "mr AS (SELECT rk.method, cov._id, rk.task, cov.start, cov.n, cov.term, min(rk.rank) AS mr FROM cov "
        "JOIN rk ON rk._id = cov._id AND rk.pos = cov.pos GROUP BY rk.method, cov._id, rk.task, cov.start, cov.n, cov.term)",
        "grp AS (SELECT method, _id, task, term, mr, count(*) AS cnt FROM mr GROUP BY method, _id, task, term, mr)",
        f"pts AS (SELECT p FROM (VALUES {pts}) t(p))",
        "cuts AS (SELECT d._id, pts.p, CAST(floor(CAST(greatest(d.n_tokens - 1, 0) * pts.p AS DOUBLE) / 100) AS INTEGER) "
        "AS cut FROM dlen d CROSS JOIN pts)",
        "alive AS (SELECT g.method, g._id, g.task, c.p, g.term, sum(g.cnt) AS tf FROM grp g JOIN cuts c "
        "ON c._id = g._id WHERE g.mr > c.cut GROUP BY g.method, g._id, g.task, c.p, g.term)",
        "vv AS (SELECT a.method, a._id, a.task, a.p, a.term, a.tf * v.idf AS v FROM alive a JOIN vocab v ON v.term = a.term)",
        "nrm AS (SELECT method, _id, task, p, sqrt(sum(v * v)) AS norm FROM vv GROUP BY method, _id, task, p)",
        "dts AS (SELECT vv.method, vv._id, vv.task, vv.p, c.class, sum(vv.v * c.w) AS dot FROM vv JOIN coef c "
        "ON c.term = vv.term AND c.task = vv.task GROUP BY vv.method, vv._id, vv.task, vv.p, c.class)",
        "kk AS (SELECT mt.method, dlen._id, mt.task FROM dlen CROSS JOIN mt)",
        "sg AS (SELECT kk.method, kk._id, kk.task, cu.p, cu.cut AS removed_tokens, cl.class FROM kk "
        "JOIN cuts cu ON cu._id = kk._id JOIN classes cl ON cl.task = kk.task)",
        "sc AS (SELECT sg.*, round(coalesce(d.dot / NULLIF(n.norm, 0), 0) + b.b, 9) AS score FROM sg "
        "LEFT JOIN nrm n ON n.method = sg.method AND n._id = sg._id AND n.task = sg.task AND n.p = sg.p "
        "LEFT JOIN dts d ON d.method = sg.method AND d._id = sg._id AND d.task = sg.task AND d.p = sg.p "
        "AND d.class = sg.class JOIN bias b ON b.task = sg.task AND b.class = sg.class)",
        "bst AS (SELECT method, _id, task, p, removed_tokens, class AS pred, mx FROM (SELECT *, row_number() OVER "
        "(PARTITION BY method, _id, task, p ORDER BY score DESC, class ASC) AS rn, max(score) OVER "
        "(PARTITION BY method, _id, task, p) AS mx FROM sc) WHERE rn = 1)",
        "zz AS (SELECT sc.method, sc._id, sc.task, sc.p, sum(exp(sc.score - b.mx)) AS z FROM sc JOIN bst b "
        "ON b.method = sc.method AND b._id = sc._id AND b.task = sc.task AND b.p = sc.p "
        "GROUP BY sc.method, sc._id, sc.task, sc.p)",
        "p0 AS (SELECT method, _id, task, pred AS pred0 FROM bst WHERE p = 0)",
        "s0 AS (SELECT sc.method, sc._id, sc.task, sc.p, sc.score AS s0 FROM sc JOIN p0 ON p0.method = sc.method "
        "AND p0._id = sc._id AND p0.task = sc.task WHERE sc.class = p0.pred0)",
        "curve AS (SELECT b.method, b._id, b.task, l.label, b.pred, round(exp(s0.s0 - b.mx) / zz.z, 9) AS confidence, "
        "b.p AS removed_percentile, b.removed_tokens FROM bst b "
        "JOIN zz ON zz.method = b.method AND zz._id = b._id AND zz.task = b.task AND zz.p = b.p "
        "JOIN s0 ON s0.method = b.method AND s0._id = b._id AND s0.task = b.task AND s0.p = b.p "
        "JOIN labels_long l ON l._id = b._id AND l.task = b.task)",
    ]
    return ctes


def proba_ctes() -> list[str]:
    """``pb(_id, task, proba)``: softmax over a task's scores at its predicted class."""
    return [
        "pm AS (SELECT _id, task, max(score) AS mx FROM scores GROUP BY _id, task)",
        "pb AS (SELECT s._id, s.task, 1 / sum(exp(s.score - pm.mx)) AS proba FROM scores s JOIN pm ON pm._id = s._id AND pm.task = s.task "
        "GROUP BY s._id, s.task)",
    ]


def span_ctes(split: str = "test") -> list[str]:
    """Token attributions (punctuation kept), merged words (pieces always merge back to their token),
    and the filtered word stream used for n-grams."""
    from termlens.functions.stopwords import PUNCTUATION, SPECIAL_TOKENS

    tok_re = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
    stops = " ".join(
        f"AND NOT (st.lang = '{code}' AND lower(m.word) IN ({sql_list(stopwords_for(code))}))"
        for code in LANGUAGES_WITH_STOPWORDS)
    return [
        f"st AS (SELECT _id, lang, text FROM samples WHERE split = '{split}')",
        f"tok AS (SELECT _id, CAST(unnest(range(0, len(t))) AS INTEGER) AS tpos, unnest(t) AS token FROM "
        f"(SELECT _id, regexp_extract_all(lower(text), '{tok_re}') AS t FROM st))",
        f"uni AS (SELECT a._id, a.task, a.term, a.attr / tf.tf AS a FROM attrs a JOIN tf ON tf._id = a._id "
        f"AND tf.term = a.term WHERE a.split = '{split}' AND a.type = '1gram')",
        *proba_ctes(),
        "merged AS (SELECT tok._id, c.task, CAST(tok.tpos + 1 AS BIGINT) AS widx, tok.token AS word, "
        "coalesce(uni.a, 0) AS attr FROM tok CROSS JOIN (SELECT DISTINCT task FROM classes) c "
        "LEFT JOIN uni ON uni._id = tok._id AND uni.task = c.task AND uni.term = tok.token)",
        f"kw AS (SELECT m.* FROM merged m JOIN st ON st._id = m._id WHERE m.word NOT IN ({sql_list(SPECIAL_TOKENS)}) "
        f"AND m.word NOT IN ({sql_list(PUNCTUATION)}) {stops})",
        "ld AS (SELECT _id, task, widx, word AS w0, lead(word, 1) OVER w AS w1, lead(word, 2) OVER w AS w2, "
        "attr AS a0, lead(attr, 1) OVER w AS a1, lead(attr, 2) OVER w AS a2 FROM kw "
        "WINDOW w AS (PARTITION BY _id, task ORDER BY widx))",
        "ng AS (SELECT _id, task, lower(w0) AS term, (CAST(0 AS DOUBLE) + a0) / 1 AS attr, '1gram' AS type FROM ld "
        "UNION ALL SELECT _id, task, lower(w0 || ' ' || w1), (CAST(0 AS DOUBLE) + a0 + a1) / 2, '2gram' FROM ld "
        "WHERE w1 IS NOT NULL UNION ALL SELECT _id, task, lower(w0 || ' ' || w1 || ' ' || w2), "
        "(CAST(0 AS DOUBLE) + a0 + a1 + a2) / 3, '3gram' FROM ld WHERE w2 IS NOT NULL)",
    ]


def processed_ctes() -> list[str]:
    """T12/T13 on top of ``span_ctes``: the word-by-word fold as a recursion over word numbers. ``att`` counts dropped
    matches, so that words of one match share (sentence, att); a match counts when it spells its sentence, or when it
    is open at the end of a document whose last sentence alone is unfinished."""
    return [
        f"td AS MATERIALIZED (SELECT _id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]') AS w, "
        f"list_transform({sentence_split_sql('text')}, lambda x: lower(regexp_replace(x, '\\s', '', 'g'))) AS s FROM st)",
        "fold AS (SELECT _id, 0 AS i, 0 AS s, 0 AS o, 0 AS att, -1 AS ws, -1 AS wa, false AS fin, w AS wl, s AS sl FROM td UNION ALL "
        "SELECT _id, i + 1, CASE WHEN ok AND o + n = length(cur) THEN s + 1 ELSE s END, CASE WHEN ok AND o + n < length(cur) THEN o + n ELSE 0 END, "
        "CASE WHEN ok THEN att ELSE att + 1 END, CASE WHEN ok THEN s ELSE -1 END, att, ok AND o + n = length(cur), wl, sl FROM "
        "(SELECT *, wl[i + 1] AS word, length(wl[i + 1]) AS n, sl[s + 1] AS cur, substr(sl[s + 1], o + 1, length(wl[i + 1])) = wl[i + 1] AS ok "
        "FROM fold WHERE i < len(wl) AND s < len(sl)))",
        "fw AS MATERIALIZED (SELECT _id, i AS widx, s, o, ws, wa, fin, len(sl) AS ns FROM fold)",
        "fend AS (SELECT _id, max(ns) AS ns, arg_max(s, widx) AS s, arg_max(o, widx) AS o, arg_max(wa, widx) AS wa, count(*) FILTER (WHERE fin) AS done "
        "FROM fw GROUP BY _id)",
        "fdoc AS (SELECT *, ns > 0 AND (done = 0 OR s < ns - 1) AS whole, ns > 0 AND done > 0 AND s = ns - 1 AND o > 0 AS rest FROM fend)",
        "fgood AS (SELECT _id, ws, wa, 'sentence' AS kind FROM fw WHERE fin UNION ALL SELECT _id, s, wa, 'rest' FROM fdoc WHERE rest)",
        "sidw AS (SELECT f._id, f.widx, g.ws AS sid, g.kind FROM fw f JOIN fgood g ON g._id = f._id AND g.ws = f.ws AND g.wa = f.wa WHERE f.widx > 0)",
        "srows AS (SELECT m._id, m.task, lower(string_agg(m.word, ' ' ORDER BY m.widx)) AS term, avg(m.attr) AS attr, f.kind AS type "
        "FROM merged m JOIN sidw f ON f._id = m._id AND f.widx = m.widx GROUP BY m._id, m.task, f.sid, f.kind)",
        "skw AS (SELECT kw.*, f.sid FROM kw JOIN sidw f ON f._id = kw._id AND f.widx = kw.widx JOIN fdoc d ON d._id = kw._id WHERE NOT d.whole)",
        "sld AS (SELECT _id, task, widx, word AS w0, lead(word, 1) OVER w AS w1, lead(word, 2) OVER w AS w2, "
        "attr AS a0, lead(attr, 1) OVER w AS a1, lead(attr, 2) OVER w AS a2 FROM skw "
        "WINDOW w AS (PARTITION BY _id, task, sid ORDER BY widx))",
        "sng AS (SELECT _id, task, lower(w0) AS term, (CAST(0 AS DOUBLE) + a0) / 1 AS attr, '1gram' AS type FROM sld "
        "UNION ALL SELECT _id, task, lower(w0 || ' ' || w1), (CAST(0 AS DOUBLE) + a0 + a1) / 2, '2gram' FROM sld "
        "WHERE w1 IS NOT NULL UNION ALL SELECT _id, task, lower(w0 || ' ' || w1 || ' ' || w2), "
        "(CAST(0 AS DOUBLE) + a0 + a1 + a2) / 3, '3gram' FROM sld WHERE w2 IS NOT NULL)",
        "dng AS (SELECT ng.* FROM ng JOIN fdoc d ON d._id = ng._id WHERE d.whole)",
        "prows AS (SELECT * FROM srows UNION ALL SELECT * FROM sng UNION ALL SELECT * FROM dng)",
    ]


def ridge_ctes(tasks: TaskMap, alpha: float, tol: float, steps: int) -> list[str]:
    """V6 as ``steps`` unrolled conjugate-gradient steps over (term, k) rows, then ``rcoef``, ``rbias``, ``rscores`` and
    ``rpreds``. ``k`` numbers the one-vs-rest targets."""
    from termlens.operators.linear import ridge_targets

    targets = ridge_targets(tasks)
    values = ", ".join(f"({k}, '{t}', {c})" for k, (t, c) in enumerate(targets))
    a = f"CAST({alpha!r} AS DOUBLE)"
    out = [
        f"rt AS (SELECT * FROM (VALUES {values}) v(k, task, class))",
        "rcn AS (SELECT task, label, count(*) AS nc FROM lt WHERE label IS NOT NULL GROUP BY task, label)",
        "rcw AS (SELECT task, label, CAST(sum(nc) OVER (PARTITION BY task) AS DOUBLE) / (count(*) OVER (PARTITION BY task) * nc) AS wt FROM rcn)",
        "rd AS MATERIALIZED (SELECT lt._id, rt.k, CASE WHEN lt.label = rt.class THEN 1.0::DOUBLE ELSE -1.0 END AS y, rcw.wt AS w FROM lt "
        "JOIN rcw ON rcw.task = lt.task AND rcw.label = lt.label JOIN rt ON rt.task = lt.task)",
        "rtot AS MATERIALIZED (SELECT k, sum(w) AS tw, sum(w * y) / sum(w) AS ym FROM rd GROUP BY k)",
        "rx AS MATERIALIZED (SELECT _id, term, x FROM xt)",
        "rs0 AS MATERIALIZED (SELECT term, d.k, CAST(0 AS DOUBLE) AS c, sum(x * w * (y - ym)) AS r, sum(x * w * (y - ym)) AS p, sum(x * w) AS s "
        "FROM rx JOIN rd d USING (_id) JOIN rtot t ON t.k = d.k GROUP BY term, d.k)",
        "rr0 AS MATERIALIZED (SELECT k, sum(r * r) AS rr FROM rs0 GROUP BY k)",
        f"rlim AS MATERIALIZED (SELECT k, rr * CAST({tol * tol!r} AS DOUBLE) AS lim FROM rr0)",
    ]
    for i in range(steps):
        out += [
            f"rq{i} AS (SELECT x._id, s.k, sum(x.x * s.p) AS q FROM rx x JOIN rs{i} s USING (term) GROUP BY x._id, s.k)",
            f"ru{i} AS MATERIALIZED (SELECT x.term, q.k, sum(x.x * d.w * q.q) AS u FROM rx x JOIN rq{i} q USING (_id) "
            f"JOIN rd d ON d._id = q._id AND d.k = q.k GROUP BY x.term, q.k)",
            f"rg{i} AS MATERIALIZED (SELECT s.k, sum(p * u) AS pu, sum(p * s) AS ps, sum(p * p) AS pp FROM rs{i} s JOIN ru{i} u "
            f"ON u.term = s.term AND u.k = s.k GROUP BY s.k)",
            f"ra{i} AS MATERIALIZED (SELECT g.k, rr.rr > l.lim AS live, g.ps / t.tw AS m, "
            f"CASE WHEN rr.rr > l.lim THEN rr.rr / (g.pu - g.ps / t.tw * g.ps + {a} * g.pp) ELSE 0 END AS size, rr.rr "
            f"FROM rg{i} g JOIN rr{i} rr USING (k) JOIN rlim l USING (k) JOIN rtot t USING (k))",
            f"rn{i} AS MATERIALIZED (SELECT s.term, s.k, s.c + a.size * s.p AS c, s.r - a.size * (u.u - a.m * s.s + {a} * s.p) AS r, s.p, s.s, a.live "
            f"FROM rs{i} s JOIN ru{i} u ON u.term = s.term AND u.k = s.k JOIN ra{i} a ON a.k = s.k)",
            f"rr{i + 1} AS MATERIALIZED (SELECT k, sum(r * r) AS rr FROM rn{i} GROUP BY k)",
            f"rs{i + 1} AS MATERIALIZED (SELECT n.term, n.k, n.c, n.r, CASE WHEN n.live THEN n.r + b.rr / a.rr * n.p ELSE n.p END AS p, n.s "
            f"FROM rn{i} n JOIN rr{i + 1} b ON b.k = n.k JOIN ra{i} a ON a.k = n.k)",
        ]
    pairs = ", ".join(f"({k}, '{t}', {cls}, {sign})" for k, (t, c) in enumerate(targets)
                      for cls, sign in ([(0, -1), (1, 1)] if dict(tasks.tasks)[t] == 2 else [(c, 1)]))
    return out + [
        f"rsign AS (SELECT * FROM (VALUES {pairs}) v(k, task, class, sgn))",
        f"rb AS (SELECT s.k, any_value(t.ym) - sum(s.s * s.c) / any_value(t.tw) AS b FROM rs{steps} s JOIN rtot t ON t.k = s.k GROUP BY s.k)",
        f"rcoef AS MATERIALIZED (SELECT s.term, g.task, g.class, g.sgn * s.c AS w FROM rs{steps} s JOIN rsign g ON g.k = s.k)",
        "rbias AS (SELECT g.task, g.class, g.sgn * rb.b AS b FROM rb JOIN rsign g ON g.k = rb.k)",
        "rdots AS (SELECT x._id, c.task, c.class, sum(x.x * c.w) AS dot FROM x JOIN rcoef c ON x.term = c.term GROUP BY x._id, c.task, c.class)",
        "rscores AS MATERIALIZED (SELECT s._id, cl.task, cl.class, round(coalesce(d.dot, 0) + b.b, 9) AS score FROM samples s CROSS JOIN classes cl "
        "LEFT JOIN rdots d ON d._id = s._id AND d.task = cl.task AND d.class = cl.class JOIN rbias b ON b.task = cl.task AND b.class = cl.class)",
        "rpreds AS (SELECT l._id, l.task, l.label, p.class AS pred, p.score FROM labels_long l JOIN (SELECT *, row_number() OVER "
        "(PARTITION BY _id, task ORDER BY score DESC, class ASC) AS rn FROM rscores) p ON l._id = p._id AND l.task = p.task WHERE p.rn = 1)",
    ]


# Letters beyond ASCII as capitals, which lower-cased texts lack (but for those of the mask), so that ``\\b`` knows them.
LETTERS, CAPITALS = "ßäçèéêíñóöüáàâúïîôûùëœ", "BCDEFGHIJLNOPQRTUVWXYZ"


def mask_ctes(split: str = "test", limit: int = 50) -> list[str]:
    """M1: a recursion over each document's candidate terms (all words occur in it) in rank order. ``steps`` holds the
    emitted rows. An error stops the query where a document's class has fewer ranked terms than the limit (M2)."""
    to, back = f"'{LETTERS}', '{CAPITALS}'", f"'{CAPITALS}', '{LETTERS}'"
    gap = "\\b(?:[\\x00-\\x09\\x0B-\\x7F]{0,12}|\\s)\\b"
    return [
        "ranked AS MATERIALIZED (SELECT task, pred AS cls, term, row_number() OVER (PARTITION BY task, pred ORDER BY attr DESC, term ASC) AS rank FROM agg)",
        f"mdocs AS MATERIALIZED (SELECT s._id, l.task, l.label AS cls, lower(s.text) AS text, s.lang FROM samples s JOIN labels_long l ON l._id = s._id "
        f"WHERE s.split = '{split}')",
        "nterms AS (SELECT task, cls, count(*) AS n FROM ranked GROUP BY task, cls)",
        f"mguard AS MATERIALIZED (SELECT d._id, d.task, CASE WHEN coalesce(n.n, 0) < {limit} THEN error('too few ranked terms') ELSE 0 END AS g "
        f"FROM mdocs d LEFT JOIN nterms n ON n.task = d.task AND n.cls = d.cls)",
        "dwords AS MATERIALIZED (SELECT DISTINCT _id, task, cls, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS word FROM mdocs)",
        "twords AS MATERIALIZED (SELECT DISTINCT task, cls, rank, term, unnest(string_split(term, ' ')) AS word FROM ranked)",
        "tsize AS (SELECT task, cls, rank, count(*) AS k FROM twords GROUP BY task, cls, rank)",
        f"cand AS MATERIALIZED (SELECT c._id, c.task, c.rank, c.term, row_number() OVER (PARTITION BY c._id, c.task ORDER BY c.rank) AS ci, "
        f"'\\b' || replace(translate(c.term, {to}), ' ', '{gap}') || '\\b' AS pat FROM (SELECT d._id, d.task, t.cls, t.rank, t.term, count(*) AS m FROM dwords d "
        f"JOIN twords t ON t.task = d.task AND t.cls = d.cls AND t.word = d.word GROUP BY ALL) c JOIN tsize z ON z.task = c.task AND z.cls = c.cls "
        f"AND z.rank = c.rank AND z.k = c.m)",
        f"walk AS (SELECT _id, task, CAST(0 AS BIGINT) AS ci, translate(text, {to}) AS t, '' AS cum, 0 AS n, CAST(0 AS BIGINT) AS missed, CAST([] AS VARCHAR[]) AS masked, true AS hit "
        f"FROM mdocs UNION ALL SELECT _id, task, ci, CASE WHEN hit THEN regexp_replace(t, CASE WHEN cum = '' THEN pat ELSE cum || '|' || pat END, '[MASK]', 'g') "
        f"ELSE t END, CASE WHEN hit AND contains(term, ' ') THEN CASE WHEN cum = '' THEN pat ELSE cum || '|' || pat END ELSE cum END, "
        f"CASE WHEN hit THEN n + 1 ELSE n END, CASE WHEN hit THEN rank - n - 1 ELSE missed END, CASE WHEN hit THEN list_append(masked, term) ELSE masked END, hit "
        f"FROM (SELECT w._id, w.task, c.ci, w.t, w.cum, w.n, w.missed, w.masked, c.rank, c.term, c.pat, regexp_matches(w.t, c.pat) AS hit FROM walk w "
        f"JOIN cand c ON c._id = w._id AND c.task = w.task AND c.ci = w.ci + 1 WHERE w.n < {limit}))",
        f"steps AS MATERIALIZED (SELECT w._id, w.task, w.n AS n_masked_terms, w.masked AS masked_terms, CAST(w.missed + g.g AS INTEGER) AS n_missed_terms, "
        f"CAST((length(t) - length(replace(t, '[MASK]', ''))) // 6 AS INTEGER) AS n_masked_tokens, translate(t, {back}) AS text FROM walk w "
        f"JOIN mguard g ON g._id = w._id AND g.task = w.task WHERE hit)",
    ]


def mask_eval_ctes(tasks: TaskMap) -> list[str]:
    """M3/M4 on top of ``mask_ctes``: every step's text scored again; ``meval`` is the result."""
    order = "CASE task " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(tasks.names)) + " END"
    grams = ", ".join(_ngram_sql("w", n) for n in (1, 2, 3))
    labels = "[" + ", ".join(tasks.names) + "]"
    return [
        f"mw AS (SELECT _id, mtask, n, {stopword_filter_sql('w0', 'lang')} AS w FROM (SELECT p._id, p.task AS mtask, p.n_masked_terms AS n, s.lang, "
        f"regexp_extract_all(lower(p.text), '\\[mask\\]|{WORD_RE}') AS w0 FROM steps p JOIN samples s ON s._id = p._id))",
        f"mtf AS (SELECT _id, mtask, n, term, count(*) AS tf FROM (SELECT _id, mtask, n, unnest(list_concat({grams})) AS term FROM mw) GROUP BY ALL)",
        "mv AS MATERIALIZED (SELECT m._id, m.mtask, m.n, m.term, m.tf * v.idf AS v FROM mtf m JOIN vocab v ON v.term = m.term)",
        "mn AS (SELECT _id, mtask, n, sqrt(sum(v * v)) AS norm FROM mv GROUP BY ALL)",
        "mdt AS (SELECT mv._id, mv.mtask, mv.n, c.task, c.class, sum(mv.v * c.w) AS dot FROM mv JOIN coef c ON c.term = mv.term GROUP BY ALL)",
        "msc AS (SELECT p._id, p.task AS mtask, p.n_masked_terms AS n, cl.task, cl.class, round(coalesce(d.dot / NULLIF(mn.norm, 0), 0) + b.b, 9) AS score "
        "FROM steps p CROSS JOIN classes cl LEFT JOIN mn ON mn._id = p._id AND mn.mtask = p.task AND mn.n = p.n_masked_terms "
        "LEFT JOIN mdt d ON d._id = p._id AND d.mtask = p.task AND d.n = p.n_masked_terms AND d.task = cl.task AND d.class = cl.class "
        "JOIN bias b ON b.task = cl.task AND b.class = cl.class)",
        "mex AS (SELECT *, exp(score - max(score) OVER w) AS ex FROM msc WINDOW w AS (PARTITION BY _id, mtask, n, task))",
        "mpr AS (SELECT _id, mtask, n, task, list(p ORDER BY class) AS prob FROM (SELECT *, ex / sum(ex) OVER (PARTITION BY _id, mtask, n, task) AS p FROM mex) "
        "GROUP BY _id, mtask, n, task)",
        f"mlg AS MATERIALIZED (SELECT _id, mtask, n, list(prob ORDER BY {order}) AS logits, "
        f"list(CAST(list_position(prob, list_max(prob)) - 1 AS INTEGER) ORDER BY {order}) AS preds FROM mpr GROUP BY _id, mtask, n)",
        f"meval AS (SELECT p.n_masked_terms, p.masked_terms, p.n_missed_terms, p.n_masked_tokens, list_transform(g.logits, lambda a: list_transform(a, lambda x: round(x, 9))) AS logits, "
        f"g.preds, s.labels, p.text, p._id, p.task, CAST({order.replace('CASE task', 'CASE p.task')} AS INTEGER) AS task_index, "
        f"[round(g.logits[i][z.preds[i] + 1], 9) FOR i IN range(1, {len(tasks.names) + 1})] AS pred_logits FROM steps p "
        f"JOIN mlg g ON g._id = p._id AND g.mtask = p.task AND g.n = p.n_masked_terms JOIN mlg z ON z._id = p._id AND z.mtask = p.task AND z.n = 0 "
        f"JOIN (SELECT _id, {labels} AS labels FROM samples) s ON s._id = p._id)",
    ]
