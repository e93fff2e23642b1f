"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import chat_format, exact_dedup, filter_audit, html_text, importance, jaccard_join, license_scan, line_dedup, mixing, ngram_lm, packing, quality, simhash
from tidewake.llm._shared import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` mixed to the weights 3, 1, 2 by source."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` without those that begin a longer one, rendered."""
    return chat_format.collapse(table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of 512 to 8192 words."""
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of ``pages``."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct line of ``documents`` with its class of lines one edit apart."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that each of ``documents`` names."""
    found = license_scan.scan_documents(table(spark, sf_dir, "documents"))
    families = F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("found").cast("long").alias("n_notices"),
        families.alias("families"),
        F.get("found", F.lit(0))["paragraph"].alias("first_paragraph"),
        F.round(F.array_max(F.transform("found", lambda x: x["similarity"])), 6).alias("similarity"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose fingerprints differ in at most 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of ``documents``."""
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of ``documents`` by unigrams and by the Kneser-Ney model."""
    return ngram_lm.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among ``documents``."""
    marked = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` drawn towards the words of ``benchmark``."""
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose sets of four-word shingles are alike to 85 %."""
    found = jaccard_join.similar_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from ``documents`` by source, in every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_chat_format, op3_packing, op4_html_extraction, op5_line_dedup, op6_license_scan, op7_simhash, op8_quality, op9_ngram_lm, op10_exact_dedup, op11_importance_resampling, op12_jaccard_join, op13_filter_audit)
}

_WORD = "[^\\x20\\x09-\\x0D]+"


def _quality_sql() -> str:
    """Counts by unnesting words; verdicts from the definition of the estimate, by elimination without roots."""
    four = (1, 2, 3, 4)
    expression = {1: "ln((word_chars + 1) / (n_words + 1)::double)", 2: "sqrt(n_symbols / (word_chars + 1)::double)", 3: "sqrt(n_dup_lines / (n_lines + 1)::double)", 4: "sqrt(n_repeat_words / (n_words + 1)::double)"}
    spread = {1: 0.08, 2: 0.05, 3: 0.15, 4: 0.13}
    xs = ", ".join(f"x{i}" for i in four)
    real = "{}::double".format
    cell = {i: real(repr(spread[i] * 65536 / 64)) for i in four}

    def estimate(rows: str) -> str:
        """Mean, and the factors f and pivots p of the covariance's elimination, of every key and start."""
        sums = ", ".join([f"sum(x{i}::hugeint)::double / count(*) as m{i}" for i in four] + [f"sum(x{i}::hugeint * x{j})::double / count(*) as q{i}{j}" for i in four for j in range(1, i + 1)])
        text = f"select key, start, {sums} from {rows} group by key, start"
        cov = ", ".join(f"1.487::double * (q{i}{j} - m{i} * m{j})" + (f" + {real(repr((spread[i] * 65536) ** 2))}" if i == j else "") + f" as c{i}{j}" for i in four for j in range(1, i + 1))
        text = f"select *, {cov} from ({text}) t0"
        for k in four:
            below = range(k + 1, 5)
            factors = ", ".join([f"c{k}{k} as p{k}", *(f"c{i}{k} / c{k}{k} as f{i}{k}" for i in below)])
            rest = ", ".join(f"c{i}{j} - c{i}{k} / c{k}{k} * c{j}{k} as c{i}{j}" for i in below for j in range(k + 1, i + 1))
            text = f"select * {f'replace ({rest})' if rest else ''}, {factors} from ({text}) t{k}"
        return text

    def distance(rows: str, est: str, on: str) -> str:
        y = {}
        text = f"select v.*, {', '.join(f'e.m{i}, e.p{i}' for i in four)}, {', '.join(f'e.f{i}{k}' for i in four for k in range(1, i))} from {rows} v join {est} e on {on}"
        for i in four:
            y[i] = f"x{i} - m{i}" + "".join(f" - f{i}{k} * y{k}" for k in range(1, i))
            text = f"select *, {y[i]} as y{i} from ({text}) u{i}"
        return f"select *, {' + '.join(f'y{i} * y{i} / p{i}' for i in four)} as d2 from ({text}) u"

    square = {i: f"(x{i} - c.x{i}) / {real(repr(spread[i] * 65536))} * ((x{i} - c.x{i}) / {real(repr(spread[i] * 65536))})".replace("(x", "(s.x") for i in four}
    steps = [
        "d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, lang, source from documents)",
        f"w as (select r, doc_id, lang, source, text, regexp_extract_all(text, '{_WORD}') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls from d)",
        "t as (select r, i, three from (select r, unnest(range(1, len(ws) - 1)) as i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as three from w where len(ws) > 2) q)",
        "rep as (select r, count(distinct i + k) as n from (select r, i, count(*) over (partition by r, three) as c from t) a, (values (0), (1), (2)) o(k) where c > 1 group by r)",
        """stats as (select w.r, doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
            cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
            from w left join rep on w.r = rep.r)""",
        "judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from stats)",
        f"v as (select r, lang, source, {', '.join(f'round(({expression[i]}) * 65536)::bigint as x{i}' for i in four)}, count(*) over (partition by lang, source) as n3, count(*) over (partition by lang) as n2 from judged where not base_failed)",
        "k as (select *, case when n3 >= 100 then 1 when n2 >= 100 then 2 else 3 end as kind, to_json({'l': lang, 's': source})::varchar as k1, to_json({'l': lang})::varchar as k2, 'all' as k3 from v)",
        f"m as (select r, k1 as key, {xs} from k where kind = 1 union all select r, k2, {xs} from k where k2 in (select k2 from k where kind = 2) union all select r, k3, {xs} from k where exists (select 1 from k where kind = 3))",
        f"s as (select m.*, a.start from m, (values (0), (1), (2)) a(start))",
        f"c as (select key, {', '.join(f'(quantile_disc(floor(x{i} / {cell[i]}), 0.5) + 0.5::double) * {cell[i]} as x{i}' for i in four)} from m group by key)",
        f"whole as ({estimate('(select * from s where start = 1) w0')})",
        f"d0 as materialized (select s.key, s.start, s.r, {', '.join(f's.x{i}' for i in four)}, case start when 0 then {' + '.join(square.values())} else greatest({', '.join(square.values())}) end as d2 from s join c on s.key = c.key where start <> 1"
        f" union all select key, start, r, {xs}, d2 from ({distance('(select * from s where start = 1)', 'whole', 'v.key = e.key')}) z)",
    ]
    for k in range(quality.MOST_STEPS):
        steps.append(f"core{k} as (select d{k}.* from d{k} join (select key, start, quantile_disc(floor(ln(1 + d2) * 256), 0.75) as edge from d{k} group by key, start) e on d{k}.key = e.key and d{k}.start = e.start where floor(ln(1 + d2) * 256) <= edge)")
        steps.append(f"est{k} as materialized ({estimate(f'core{k}')})")
        steps.append(f"d{k + 1} as materialized (select key, start, r, {xs}, d2 from ({distance('s', f'est{k}', 'v.key = e.key and v.start = e.start')}) z)")
    last = f"est{quality.MOST_STEPS - 1}"
    steps.append(f"best as (select * from {last} qualify row_number() over (partition by key order by round(ln(p1 * p2 * p3 * p4) / 2, 12), start) = 1)")
    steps.append(f"far as ({distance('(select *, case kind when 1 then k1 when 2 then k2 else k3 end as key from k)', 'best', 'v.key = e.key')})")
    return "with " + ", ".join(steps) + """ select j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
        not j.base_failed and coalesce(x.d2, 0) <= 23.51::double as kept from judged j left join far x on j.r = x.r"""


ORACLES: dict[str, str] = {
    "op2_chat_format": """with o as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as p,
            count(*) over (partition by conv_id) as n from conversations),
        pre as (select conv_id, p, n, role, text, string_agg(coalesce('=' || role, '-') || chr(1) || coalesce('=' || text, '-'), chr(2)) over (partition by conv_id order by p) as prefix from o),
        best as (select prefix, first(conv_id order by n desc, conv_id nulls last) as kept_by from pre group by prefix),
        fate as (select conv_id, n, best.kept_by, conv_id is not distinct from best.kept_by as kept from pre join best using (prefix) where p = n),
        shown as (select o.conv_id, (p - 1) // 64 as chunk, string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' order by p) as text
            from o join fate on o.conv_id is not distinct from fate.conv_id and fate.kept group by all)
        select fate.conv_id, n as n_turns, kept, kept_by, chunk, text from fate left join shown on fate.conv_id is not distinct from shown.conv_id and kept""",
    "op5_line_dedup": r"""with recursive d as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
        l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as line_no from d),
        u as (select left(sha256(line), 32) as id, line, length(line) as n, count(*) as n_rows, first(doc_id order by doc_id nulls first, line_no) as first_doc, first(line_no order by doc_id nulls first, line_no) as first_line
            from l where not regexp_full_match(line, '[\x20\x09\x0B-\x0D]*') group by line),
        k as (select id, n as size, 0 as role, 'before' as part, left(line, n // 2) as piece from u union all select id, n, 0, 'after', substr(line, n // 2 + 1) from u
            union all select id, n - 1, 1, 'before', left(line, (n - 1) // 2) from u union all select id, n - 1, 1, 'after', substr(line, (n - 1) // 2 + 2) from u),
        met as (select distinct a.id as a, b.id as b from k a join k b on a.size = b.size and a.part = b.part and a.piece = b.piece and a.role = 0 and (b.role = 1 or a.id < b.id)),
        couple as (select a, b, x.line as s, y.line as t, x.n as m, y.n as n from met join u x on x.id = a join u y on y.id = b),
        same as (select *, coalesce(list_position(list_transform(range(1, m + 1), lambda i: s[i] is distinct from t[i]), true) - 1, m) as p from couple),
        links as (select a, b from same where case when m = n then substr(s, p + 2) = substr(t, p + 2) else substr(s, p + 1) = substr(t, p + 2) end),
        ends as (select a, b from links union select b, a from links),
        reach as (select a, b from ends union select r.a, e.b from reach r join ends e on r.b = e.a),
        class as (select a, min(b) as least from reach group by a), degree as (select a, count(*) as n_links from ends group by a)
        select id as line_id, first_doc, first_line, n as n_chars, n_rows, coalesce(n_links, 0) as n_links, coalesce(least, id) as class_id from u left join class on class.a = id left join degree on degree.a = id""",
    "op8_quality": _quality_sql(),
    "op10_exact_dedup": """select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
        row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window g as (partition by coalesce(text, ''))""",
    "op11_importance_resampling": r"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
        b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
        dw as (select r, w, count(*) as c from (select r, unnest(ws) as w from d) group by all), bw as (select w, count(*) as c from b group by w),
        nibble as (select list_transform(range(16), lambda v: list_reduce([v::bigint, 0, 0, 0, 0], lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
        words as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
        steps as (select w, list_transform(range(length(x)), lambda i: (position(x[i + case when i % 2 = 0 then 2 else 0 end] in '0123456789ABCDEF') - 1)::bigint) as ns from words),
        bucket as (select w, xor(list_reduce(list_prepend(4294967295::bigint, ns), lambda a, v: xor(a >> 4, t[(xor(a, v) & 15) + 1])), 4294967295) % 10000 as k from steps, nibble),
        s as (select k, sum(c) as n from dw join bucket using (w) group by k), t as (select k, sum(c) as n from bw join bucket using (w) group by k),
        gain as (select u.k, floor(1000.0::double * ln((coalesce(t.n, 0)::double + 1) * ((select coalesce(sum(n), 0) from s)::double + 10000) / ((coalesce(s.n, 0)::double + 1) * ((select coalesce(sum(n), 0) from t)::double + 10000))))::bigint as g
            from (select unnest(range(10000)) as k) u left join s on s.k = u.k left join t on t.k = u.k),
        weight as (select r, sum(c * g)::bigint as weight from dw join bucket using (w) join gain using (k) group by r),
        score as (select d.r, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
            coalesce(weight, 0) + floor(-1000.0::double * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score from d left join weight on weight.r = d.r),
        place as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) end as p, count(*) filter (n_features >= 20) over () as n from score)
        select doc_id, n_features, weight, score, case when p <= 10 * n // 100 then p end as rank from place""",
    "op12_jaccard_join": r"""with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
        s as (select r, doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
            else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) end as sh from d),
        g as (select *, len(sh)::bigint as n, case when len(sh) > 0 then first_value(r) over (partition by list_sort(sh) order by r) else r end as rep from s),
        x as (select rep, n, unnest(sh) as w from g where r = rep),
        links as (select a.rep as a, b.rep as b from x a join x b on a.w = b.w and a.rep < b.rep and a.n * 100 >= 85 * b.n and b.n * 100 >= 85 * a.n group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        ends as (select a, b from links union select b, a from links),
        reach as (select a, b from ends union select r.a, e.b from reach r join ends e on r.b = e.a),
        class as (select a, least(a, min(b)) as label from reach group by a),
        named as (select g.*, coalesce(label, rep) as label from g left join class on class.a = g.rep)
        select doc_id, n as n_shingles, case when n > 0 then min(doc_id) over (partition by label) else doc_id end as component_id from named""",
    "op13_filter_audit": r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, min(doc_id) over (partition by coalesce(text, '')) as low, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        fails as (select doc_id, part, len(ws) < 200 as a, 100 * len(list_distinct(ws)) < 50 * len(ws) as b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
            low is not null and coalesce(doc_id > low, true) as e from d),
        says as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
        row_of as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [a, b, c, d, e] as f, list_sum([a, b, c, d, e]::int[]) as k from fails left join says using (doc_id)),
        letters as (select unnest([1, 2, 3, 4, 5]) as i),
        orders as (select [v.i, w.i, x.i, y.i, z.i] as o from letters v, letters w, letters x, letters y, letters z where len(list_distinct([v.i, w.i, x.i, y.i, z.i])) = 5),
        steps as (select o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') as filter_order, unnest([1, 2, 3, 4, 5]) as step from orders),
        alike as (select part, f, k, count(*) as n, sum(good) as good, sum(toxic) as toxic from row_of group by all),
        met as (select part, filter_order, step, n, good, toxic, k, f[o[step]] as fails, list_bool_or(list_transform(o[1:step - 1], lambda i: f[i])) is true as gone from alike, steps)
        select part, filter_order, step::int as step, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed, coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant,
            coalesce(sum(n) filter (fails and k = 1), 0)::bigint as unique_fails, coalesce(sum(good) filter (fails and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (fails and not gone), 0)::bigint as toxic_lost,
            coalesce(sum(n * 120 / k) filter (fails), 0)::bigint as shapley from met group by all""",
}
