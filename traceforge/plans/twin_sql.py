"""The registered queries in DuckDB SQL, for comparison by value."""

from __future__ import annotations

from traceforge.constants import (
    ANSWER_FORCE_STRING,
    R1_SENTENCE_END,
    REJECTION_THRESHOLD,
    RESPONSE_MARKERS,
    SYSTEM_PROMPT,
    TRAIN_FRACTION,
    TRAINING_MAX_LENGTH,
)
from traceforge.operators.bootstrap import THRESHOLDS
from traceforge.plans.fixtures import EDGE_CASES

SEED, TRACE_THRESHOLD, FLUENT = 42, 3.64, 7.9


def q(value: str) -> str:
    """SQL text literal; DuckDB takes backslashes and newlines as they are."""
    return "'" + value.replace("'", "''") + "'"


QWEN, R1, LLAMA = (q(RESPONSE_MARKERS[n]) for n in ("qwen", "r1", "llama"))
FORCE = q(ANSWER_FORCE_STRING)
TOKENS = r"regexp_extract_all(lower({0}), '<\|[a-z_]+\|>|[\p{{L}}\p{{N}}]+|[^\x20\x09-\x0D\p{{L}}\p{{N}}]')"
BOXED = r"'\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}'"
NUMBER = r"'-?\d[\d,]*(?:\.\d+)?(?:/\d+)?'"
PLAIN = r"'^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$'"


def words(column: str) -> str:
    return TOKENS.format(column)


def strip(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def message(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10)"


def answer(text: str) -> str:
    return (
        f"coalesce(list_extract(regexp_extract_all({text}, {BOXED}, 1), -1),"
        f" list_extract(regexp_extract_all({text}, {NUMBER}), -1))"
    )


def normal(text: str) -> str:
    out = rf"regexp_replace({text}, '\\left|\\right|\\[!,$]|\$|\s+', '', 'g')"
    # RE2 has no lookahead: a digit may be shared by two commas, hence twice.
    for _ in range(2):
        out = rf"regexp_replace({out}, '(\d),(\d)', '\1\2', 'g')"
    out = rf"regexp_replace({out}, '\\text\{{([^{{}}]*)\}}', '\1', 'g')"
    out = rf"regexp_replace({out}, '\\[dt]frac', '\\frac', 'g')"
    out = rf"regexp_replace({out}, '\\frac\{{(-?\d+)\}}\{{(-?\d+)\}}', '\1/\2', 'g')"
    return rf"lower(regexp_replace({out}, '\.$', ''))"


def number(text: str) -> str:
    def plain(part):
        return f"case when regexp_matches({part}, {PLAIN}) then try_cast({part} as double) end"

    parts = f"string_split({text}, '/')"
    return (
        f"case len({parts}) when 1 then {plain(text)} when 2 then"
        f" {plain(f'{parts}[1]')} / nullif({plain(f'{parts}[2]')}, 0) end"
    )


def equal(gold: str, other: str) -> str:
    """Both are columns of normalised answers with a ``_v`` value beside them."""
    return (
        f"(coalesce({gold} = {other}, false) or coalesce(abs({gold}_v - {other}_v) <="
        f" 1e-6 * greatest(1, abs({gold}_v), abs({other}_v)), false))"
    )


def graded(rows: str, trace: str, name: str) -> str:
    """CTE body: ``rows`` with a boolean ``name``."""
    tail = f"list_extract(string_split({trace}, {FORCE}), -1)"
    forced = f"contains({trace}, {FORCE})"
    head = f"left({trace}, length({trace}) - length({tail}) - {len(ANSWER_FORCE_STRING)})"
    return f"""
    select * exclude (g, a0, a1, a2, g_v, a0_v, a1_v, a2_v),
      {equal('g', 'a0')} or {equal('g', 'a1')} or {equal('g', 'a2')} as {name}
    from (select *, {number('g')} as g_v, {number('a0')} as a0_v, {number('a1')} as a1_v, {number('a2')} as a2_v
      from (select *, {normal(answer('solution'))} as g, {normal(answer(trace))} as a0,
          {normal(answer(f'case when {forced} then {head} end'))} as a1,
          {normal(answer(f'case when {forced} then {tail} end'))} as a2
        from {rows}))"""


F2 = f"""select o_orderkey as problem_id, o_orderpriority as run, 'q ' || o_orderkey as problem,
  '\\boxed{{' || (o_orderkey % 97) || '}}' as solution,
  '<|im_start|>user' || chr(10) || 'q ' || o_orderkey || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
    || 'work \\boxed{{' || ((case when o_orderkey % 5 = 0 then o_orderkey + 1 else o_orderkey end) % 97)
    || '}}<|im_end|>' || case when o_orderkey % 10 = 0 then {FORCE} || (o_orderkey % 97) || '}}\\]' else '' end as trace
  from orders"""

FAMILY = f"""select doc_id, '<s>ask ' || case doc_id % 4
    when 0 then {QWEN} || text || '<|im_end|>' || chr(10) || '<|im_end|>'
    when 1 then {R1} || text || '</think>' || {q(R1_SENTENCE_END)}
    when 2 then {LLAMA} || text else text end as trace from documents"""

CANDIDATES = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_extendedprice) / 10000 as price,
    min(l_discount) * 100 as score, min(l_tax) as plus, min(l_quantity) / 50 as minus,
    l_orderkey % 4 as shard from lineitem group by all"""

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
CANDIDATE = "l_linenumber, l_partkey, l_suppkey"
PAIRS = """select u.conv_id, u.turn, u.text as problem, a.text as response from conversations u
  join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant'"""
DOC_TOKENS = f"select doc_id, lang, {words('text')} as tokens from documents"
DOC_IDS = f"select doc_id, list_transform(tokens, lambda t: length(t)) as ids from ({DOC_TOKENS})"
MCQ = """select p_partkey as problem_id,
  p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_size
    || chr(10) || 'D. none' as problem,
  '\\boxed{' || chr((65 + p_partkey % 4)::INT) || '}' as solution from part"""
BENCHMARK = "select item_id as problem_id, text as problem, text as solution from benchmark"


def seeded(key: str) -> str:
    return f"md5(concat_ws('|', {key}, '{SEED}'))"


def forced(marker: str) -> str:
    return f"""trace || case when contains(list_extract(string_split(trace, {marker}), -1), '</think>') then ''
   else chr(10) || '</think>' end || {FORCE}"""


# Answers forced on the solved orders: every marker but qwen's is absent there.
AF_OPEN = f"replace({forced(QWEN)}, '<|im_end|>', '')"
GRADED_RAW = f"f2 as ({F2}), raw as ({graded('f2', 'trace', 'is_raw_correct')})"
GRADED = f"""{GRADED_RAW}, af as (select *, {AF_OPEN} || '<|im_end|>' as trace_af from raw),
  done as ({graded('af', 'trace_af', 'is_af_correct')})"""
GRADED_MORE = f"""{GRADED_RAW}, af as (select *, {AF_OPEN} || (problem_id % 97) || '}}\\]<|im_end|>' as trace_af from raw),
  done as ({graded('af', 'trace_af', 'is_af_correct')})"""

ACCURACY = f"""with {GRADED} select run, count(*) as traces, round(avg(is_raw_correct::INT), 6) as raw_accuracy,
  round(avg(is_af_correct::INT), 6) as af_accuracy from done group by run"""

SOFTMAX = f"""c as ({CANDIDATES}), e as (select *, exp((score - max(score) over (partition by l_orderkey)) / 2.0::DOUBLE) as mass from c),
  p as (select *, mass / sum(mass) over (partition by l_orderkey) as probability from e)"""
NUCLEUS = f"""{SOFTMAX}, r as (select *, sum(probability) over (partition by l_orderkey order by probability desc,
    {CANDIDATE} rows unbounded preceding) as upto from p),
  k as (select *, probability / sum(probability) over (partition by l_orderkey) as share from r
    where upto - probability < 0.95::DOUBLE)"""

REJECTION = f"""c as (select *, price <= 2.5::DOUBLE as ok, {seeded(LINE)} as h from ({CANDIDATES})),
  o as (select *, sum(ok::INT) over (partition by shard order by l_linenumber, h, {LINE} rows unbounded preceding) as a,
    row_number() over (partition by shard, l_linenumber order by h, {LINE}) as pos,
    count(*) over (partition by shard, l_linenumber) as n_cycle,
    row_number() over (partition by shard order by l_linenumber, h, {LINE}) as place from c),
  s as (select shard, count(*) as n,
    min(case when ok and a = 1000 then place - pos + least(ceil(pos / 512.0::DOUBLE) * 512, n_cycle) end) as paid,
    sum((a - ok::INT < 1000 and not ok)::INT) as rejected, sum((a - ok::INT < 1000 and ok)::INT) as accepted,
    max(case when ok and a <= 1000 then price end) as top, sum(case when ok and a <= 1000 then price end) as total
    from o group by shard),
  t as (select shard::VARCHAR as shard, coalesce(paid, n)::BIGINT as generated, rejected::BIGINT as rejected,
    accepted::BIGINT as accepted, accepted < 1000 as exhausted, top, total from s),
  g as (select shard, sum(generated)::BIGINT as generated, sum(rejected)::BIGINT as rejected,
    sum(accepted)::BIGINT as accepted, bool_or(exhausted) as exhausted, max(top) as top, sum(total) as total
    from t group by rollup (shard)),
  report as (select shard, generated, rejected, accepted, round(accepted / greatest(generated, 1)::DOUBLE, 6) as acceptance_rate,
    2.5::DOUBLE as threshold, true as all_below_threshold, round(top, 6) as max_accepted,
    round(total / accepted, 6) as mean_accepted, exhausted from g)"""

UNIGRAMS = f"""d as ({DOC_TOKENS}), x as (select doc_id, unnest(tokens) as w2, generate_subscripts(tokens, 1) - 1 as position from d),
  m as (select w2, count(*) as n from x group by w2), z as (select sum(n) as total, count(*) + 1 as types from m)"""
BIGRAMS = f"""d as ({DOC_TOKENS}), y as (select doc_id, lead(w2) over (partition by doc_id order by position) as w2, w2 as w1
    from (select doc_id, unnest(tokens) as w2, generate_subscripts(tokens, 1) as position from d)),
  x as (select * from y where w2 is not null), m as (select w1, w2, count(*) as n from x group by all),
  cx as (select w1, sum(n) as given from m group by w1), z as (select count(distinct w2) + 1 as types from m)"""


def statistics(value: str) -> str:
    return f"""count({value}) as count, round(avg({value}), 6) as mean, round(stddev_samp({value}), 6) as std,
      round(min({value}::DOUBLE), 6) as min, round(quantile_cont({value}::DOUBLE, 0.25), 6) as q25,
      round(quantile_cont({value}::DOUBLE, 0.5), 6) as q50, round(quantile_cont({value}::DOUBLE, 0.75), 6) as q75,
      round(max({value}::DOUBLE), 6) as max"""


def dotted(prefix: str, value: str) -> str:
    out = statistics(value)
    for name in ("count", "mean", "std", "min", "q25", "q50", "q75", "max"):
        out = out.replace(f" as {name}", f' as "{prefix}.{name}"')
    return out


NESTED = f"""with {GRADED_RAW} select run, 512 as "settings.batch", round(avg(is_raw_correct::INT), 6) as "stats.raw_accuracy",
  count(*) as "stats.lengths.count", max(length(trace))::INT as "stats.lengths.max" from raw group by run"""


def masked(ids: str) -> str:
    """Last start of [2, 3] in ``ids``, as SQL over one row."""
    return f"list_max(list_filter(range(1, len({ids})), lambda p: {ids}[p] = 2 and {ids}[p + 1] = 3))"


def as_text(ids: str) -> str:
    return f"coalesce(array_to_string({ids}, ','), '')"


TRAINING = f"""pairs as ({PAIRS}), t as (select conv_id, turn, {words(
    message('system', q(SYSTEM_PROMPT)) + ' || ' + message('user', strip('problem')) + ' || ' + message('assistant', strip('response'))
  )} as tokens from pairs),
  x as (select conv_id, turn, unnest(tokens) as token, generate_subscripts(tokens, 1) as position from t),
  v as (select token, row_number() over (order by count(*) desc, token) as id from x group by token),
  e as (select conv_id, turn, list(id order by position) as ids from x join v using (token) group by all),
  tail as (select *, (select id from v where token = '<|im_end|>') as eos, (select id from v where token = '<|im_start|>') as t0,
    (select id from v where token = 'assistant') as t1 from e),
  s as (select *, ids[1:greatest(1, list_max(list_filter(range(1, len(ids) + 1), lambda p: ids[p] <> eos)))] as kept from tail),
  c as (select *, kept[1:{TRAINING_MAX_LENGTH}] as cut from s),
  l as (select *, list_max(list_filter(range(1, len(cut)), lambda p: cut[p] = t0 and cut[p + 1] = t1)) as found from c)"""


# The whole trace stage: shards by position, unigram scores, quota, grades.
def stage(problems: str) -> str:
    return f"""f2 as ({problems}), b as (select s.range as shard, s.range * (n // 4) + least(s.range, n % 4) as first,
    (s.range + 1) * (n // 4) + least(s.range + 1, n % 4) as past from (select count(*) as n from orders), range(4) as s),
  sharded as (select problem_id, problem, solution, shard::INT as shard
    from (select *, row_number() over (order by problem_id) - 1 as i from f2) join b on i >= first and i < past),
  ct as (select l_orderkey as problem_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey as candidate,
    '<|im_start|>assistant' || chr(10) || 'flag ' || min(l_returnflag) || ' part ' || l_partkey || ' status ' || min(l_linestatus)
      || ' so \\boxed{{' || ((l_orderkey + l_linenumber % 2) % 97) || '}}<|im_end|>' as trace
    from lineitem group by l_orderkey, l_linenumber, l_partkey, l_suppkey)"""


BUILT = f"""{stage(F2)},
  x as (select problem_id, candidate, unnest({words('trace')}) as w from ct),
  m as (select w, count(*) as n from x group by w), z as (select sum(n) as total, count(*) + 1 as types from m),
  sc as (select problem_id, candidate, avg(-ln((n + 1.0::DOUBLE) / (total + types))) as ppl from x join m using (w), z group by all),
  tried as (select *, ppl <= {TRACE_THRESHOLD}::DOUBLE as ok, {seeded('problem_id, candidate')} as h from sc join sharded using (problem_id)),
  o as (select *, sum(ok::INT) over (partition by shard order by h rows unbounded preceding) as a,
    row_number() over (partition by shard order by h) as pos, count(*) over (partition by shard) as n from tried),
  taken as (select * exclude (n) from o join ct using (problem_id, candidate) where ok and a <= 500)"""
BUILT_DONE = f"""{BUILT}, raw as ({graded('taken', 'trace', 'is_raw_correct')}),
  af as (select *, {AF_OPEN} || '<|im_end|>' as trace_af from raw), done as ({graded('af', 'trace_af', 'is_af_correct')})"""
PROMPT = f"""{message('system', q(SYSTEM_PROMPT))} || {message('user', "problem || chr(10)")} || '<|im_start|>assistant' || chr(10)"""

# The stage without rejection: scores behind prompts of different length, answers forced and continued.
PLAIN_F2 = """select o_orderkey as problem_id, repeat('please ', (o_orderkey % 3)::INT) || 'q ' || o_orderkey as problem,
  '\\boxed{' || (o_orderkey % 97) || '}' as solution from orders"""
PLAIN_STAGE = f"""{stage(PLAIN_F2)}, p as (select *, {PROMPT} as prompt from ct join sharded using (problem_id)),
  t as (select problem_id, candidate, len({words('prompt')}) as skip, list_concat({words('prompt')}, {words('trace')}) as tokens from p),
  x as (select problem_id, candidate, skip, unnest(tokens) as w, generate_subscripts(tokens, 1) - 1 as position from t),
  m as (select w, count(*) as n from x group by w), z as (select sum(n) as total, count(*) + 1 as types from m),
  sc as (select problem_id, candidate, avg(-ln((n + 1.0::DOUBLE) / (total + types))) filter (position >= skip) as ppl
    from x join m using (w), z group by problem_id, candidate),
  kept as (select * from p join sc using (problem_id, candidate)), raw as ({graded('kept', 'trace', 'is_raw_correct')}),
  af as (select *, {AF_OPEN} || ((problem_id + (string_split(candidate, '-')[1]::INT % 3 = 0)::INT) % 97) || '}}\\]<|im_end|>' as trace_af from raw),
  done as ({graded('af', 'trace_af', 'is_af_correct')})"""


LAZY = f"""c as ({CANDIDATES}), o as (select *, price <= 2.5::DOUBLE as ok,
    sum((price <= 2.5::DOUBLE)::INT) over w as a, row_number() over w as pos, count(*) over (partition by shard) as n
    from c window w as (partition by shard order by {seeded(LINE)}, {LINE} rows unbounded preceding))"""


def drawn(run: str, score: str) -> str:
    """One draw per order from the nucleus of these scores."""
    return f"""select '{run}' as run, {LINE} from (select *, row_number() over (partition by l_orderkey order by
        -ln(1 - ('0x' || substr({seeded(LINE)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) / share) as place
      from (select *, probability / sum(probability) over (partition by l_orderkey) as share
        from (select *, sum(probability) over (partition by l_orderkey order by probability desc, {CANDIDATE} rows unbounded preceding) as upto
          from (select *, mass / sum(mass) over (partition by l_orderkey) as probability
            from (select *, exp((s - max(s) over (partition by l_orderkey)) / 2.0::DOUBLE) as mass
              from (select *, {score} as s from ({CANDIDATES})))))
        where upto - probability < 0.95::DOUBLE)) where place = 1"""


def drawn_traces(run: str, score: str) -> str:
    """``drawn`` for the candidate traces of ``r``."""
    return f"""select '{run}' as run, problem_id, candidate from (select *, row_number() over (partition by problem_id order by
        -ln(1 - ('0x' || substr({seeded('problem_id, candidate')}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) / share) as place
      from (select *, probability / sum(probability) over (partition by problem_id) as share
        from (select *, sum(probability) over (partition by problem_id order by probability desc, candidate rows unbounded preceding) as upto
          from (select *, mass / sum(mass) over (partition by problem_id) as probability
            from (select *, exp((s - max(s) over (partition by problem_id)) / 0.25::DOUBLE) as mass
              from (select *, {score} as s from r))))
        where upto - probability < 0.95::DOUBLE)) where place = 1"""


# Mean token shares of the right traces, the gradient, both shifted models and their scores.
SHIFTED = f"""{stage(F2)},
  x as (select problem_id, candidate, unnest({words('trace')}) as w from ct),
  k as (select problem_id, candidate, count(*) as len, string_split(candidate, '-')[1]::INT % 2 = 0 as clean from x group by all),
  m as (select w, count(*) as n from x group by w), z as (select sum(n) as total, count(*) + 1 as types from m),
  sh as (select w, sum(1.0::DOUBLE / len) / (select count(*) from k where clean) as share from x join k using (problem_id, candidate) where clean group by w),
  g as (select w, ln((n + 0.5::DOUBLE) / (total + 0.5::DOUBLE * types)) as base, coalesce(share, 0) - exp(base) as g from m left join sh using (w), z),
  u as (select ln(0.5::DOUBLE / (total + 0.5::DOUBLE * types)) as rest from z),
  norm as (select ln(sum(exp(base + 0.5::DOUBLE * g)) + any_value(exp(rest - 0.5::DOUBLE * exp(rest)))) as p,
    ln(sum(exp(base - 0.5::DOUBLE * g)) + any_value(exp(rest + 0.5::DOUBLE * exp(rest)))) as q from g, u),
  sides as (select problem_id, candidate, avg(base) as score, avg(base + 0.5::DOUBLE * g - p) as plus, avg(base - 0.5::DOUBLE * g - q) as minus
    from x join g using (w), norm group by problem_id, candidate)"""


def student_loss(order: int) -> str:
    """Losses on the holdout of models fitted on three selections of the rest."""
    grams = "w2" if order == 1 else "w1, w2"
    pairs = "" if order == 1 else """, y as (select *, lead(w) over (partition by doc_id order by position) as next from u)"""
    items = "select doc_id, w as w2 from u" if order == 1 else "select doc_id, w as w1, next as w2 from y where next is not null"
    names = ("all", "fluent", "good")
    flags = ("not held", "not held and coalesce(ppl <= {FLUENT}, false)", "not held and coalesce(quality = 1, false)")
    columns = ", ".join(f"{f} as s{i}".replace("{FLUENT}", f"{FLUENT}::DOUBLE") for i, f in enumerate(flags))
    if order == 1:
        given = [f"(select sum(n{i}) from c)" for i in range(3)]
    else:
        given = [f"(sum(n{i}) over (partition by w1))" for i in range(3)]
    chance = ", ".join(
        f"-ln((n{i} + 1.0::DOUBLE) / ({given[i]} + (select count(distinct w2) filter (n0 + n1 + n2 > 0) + 1 from c))) as l{i}" for i in range(3)
    )
    rows = " union all ".join(
        f"select '{n}' as train_set, (select count(*) filter (s{i}) from k)::BIGINT as rows, v{i} as loss, exp(v{i}) as perplexity, v{i} - v0 as loss_delta from v"
        for i, n in enumerate(names)
    )
    return f"""with d as ({DOC_TOKENS}), h as (select doc_id,
        row_number() over (order by {seeded('doc_id')}, doc_id) > floor(count(*) over () * {TRAIN_FRACTION}::DOUBLE) as held from documents),
      u as (select doc_id, unnest(tokens) as w, generate_subscripts(tokens, 1) as position from d),
      tm as (select w, count(*) as n from u join h using (doc_id) where not held group by w),
      tz as (select sum(n) as total, count(*) + 1 as types from tm),
      tp as (select doc_id, avg(-ln((n + 1.0::DOUBLE) / (total + types))) as ppl from u join h using (doc_id) join tm using (w), tz where not held group by doc_id),
      k as (select doc_id, held, {columns} from h left join tp using (doc_id) left join labels using (doc_id)){pairs},
      x as ({items}),
      c as (select {grams}, count(*) filter (held) as nh, {', '.join(f'count(*) filter (s{i}) as n{i}' for i in range(3))} from x join k using (doc_id) group by all),
      e as (select nh, {chance} from c),
      v as (select {', '.join(f'sum(l{i} * nh) / sum(nh) as v{i}' for i in range(3))} from e)
      select train_set, rows, round(loss, 6) as loss, round(perplexity, 6) as perplexity, round(loss_delta, 6) as loss_delta from ({rows})"""


EDGES = ", ".join(str(right).lower() for _, _, right in EDGE_CASES)


ORACLE: dict[str, str] = {
    "load_problems_train": f"""with f2 as ({F2}), r as (select problem_id, problem, solution,
        row_number() over (order by problem_id) as rank, count(*) over () as n from f2)
      select problem_id, problem, solution from r where rank <= floor(n * {TRAIN_FRACTION}::DOUBLE)""",
    "load_problems_holdout": f"""with p as (select doc_id as problem_id, text as problem, source as solution, lang as subset
        from documents),
      r as (select *, row_number() over (order by {seeded('problem_id')}, problem_id) as rank, count(*) over () as n from p)
      select problem_id, problem, solution, subset from r where rank > floor(n * {TRAIN_FRACTION}::DOUBLE)""",
    "load_problems_choice": MCQ,
    "load_problems_test": BENCHMARK,
    "concat_subsets": "select doc_id, source, n_chars, lang as subset from documents",
    "trace_round_trip": f"with {GRADED} select problem_id, run, trace_af, is_raw_correct, is_af_correct from done",
    "run_registry": NESTED,
    "format_mcq": MCQ,
    "render_prompt": f"""select conv_id, turn, {message('system', q(SYSTEM_PROMPT))} || {message('user', strip('text') + ' || chr(10)')}
        || '<|im_start|>assistant' || chr(10) as prompt from conversations where role = 'user'""",
    "render_chat": f"""with pairs as ({PAIRS}) select conv_id, turn, {message('system', q(SYSTEM_PROMPT))} ||
        {message('user', strip('problem'))} || {message('assistant', strip('response'))} as chat from pairs""",
    "render_conversations": f"""select conv_id, 0::BIGINT as part, {message('system', q(SYSTEM_PROMPT))}
        || string_agg('<|im_start|>' || role || chr(10) || {strip('text')} || '<|im_end|>' || chr(10), '' order by turn) as chat,
        count(*) as turns from conversations group by conv_id""",
    "conversation_parts": """with m as (select conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as m from conversations),
      b as (select *, coalesce(sum(strlen(m)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::BIGINT as before from m)
      select conv_id, before // 300 // 2 as part, string_agg(m, '' order by turn) as chat, count(*) as turns from b group by all""",
    "shifted_scores": f"with {SHIFTED} select problem_id, candidate, round(score, 6) as score, round(plus, 6) as plus, round(minus, 6) as minus from sides",
    "defence_comparison_shifted": f"""with {SHIFTED},
      r as (select problem_id, candidate, round(score, 9) as score, round(plus, 9) as plus, round(minus, 9) as minus from sides),
      picks as ({drawn_traces('clean', 'round(score, 6)')} union all
        {drawn_traces('defended', 'round(score + 40.0::DOUBLE * (plus - minus), 6)')}),
      a as (select run, count(*) as traces, avg((string_split(candidate, '-')[1]::INT % 2 = 0)::INT) as acc from picks group by run)
      select run, traces, round(acc, 6) as raw_accuracy,
        round(acc - (select acc from a where run = 'clean'), 6) as raw_accuracy_delta from a""",
    "clean_trace": "select doc_id, text || '<s></s>' as trace from documents",
    "response_family": f"""with f as ({FAMILY}) select doc_id, case when contains(trace, {LLAMA}) then 'llama'
        when contains(trace, {QWEN}) then 'qwen' when contains(trace, {R1}) then 'r1' end as family from f""",
    "extract_response": """select doc_id, case when doc_id % 4 = 0 then text else text || '</think><|im_end|>' end as response
        from documents where doc_id % 4 in (0, 1)""",
    "quarantined_responses": "select doc_id, 'no response marker' as reason from documents where doc_id % 4 in (2, 3)",
    "force_answer": f"""with f as ({FAMILY}) select doc_id, case doc_id % 4 when 0 then {forced(QWEN)}
        when 1 then {forced(R1)} when 2 then {forced(LLAMA)} end as trace_af from f""",
    "tokenize": f"select doc_id, array_to_string(tokens, ' ') as tokens, len(tokens)::INT as length from ({DOC_TOKENS})",
    "vocabulary": f"""with {UNIGRAMS} select w2 as token, n, (row_number() over (order by n desc, w2))::INT as id from m""",
    "encode_tokens": f"""with {UNIGRAMS}, v as (select w2, row_number() over (order by n desc, w2) as id from m),
      e as (select doc_id, list(id order by position) as ids from x join v using (w2) group by doc_id)
      select doc_id, {as_text('ids')} as input_ids, coalesce(len(ids), 0)::INT as length from documents left join e using (doc_id)""",
    "strip_trailing": f"""with i as (select doc_id, list_concat(ids, [9, 9]) as ids from ({DOC_IDS})),
      s as (select doc_id, ids[1:greatest(1, coalesce(list_max(list_filter(range(1, len(ids) + 1), lambda p: ids[p] <> 9)), 0))] as ids from i)
      select doc_id, {as_text('ids')} as ids, len(ids)::INT as length from s""",
    "truncate": f"""select doc_id, len(ids) > {TRAINING_MAX_LENGTH} as was_truncated, {as_text(f'ids[1:{TRAINING_MAX_LENGTH}]')} as ids from ({DOC_IDS})""",
    "completion_mask": f"""with i as (select *, {masked('ids')} as found from ({DOC_IDS}))
      select doc_id, {as_text("list_transform(ids, lambda x, j: case when j > found + 1 and x <> 1 then x else -100 end)")} as labels from i""",
    "validate_training_rows": f"""select case when len(ids) = 0 then 'empty' when {masked('ids')} is null then 'no template' else 'ok' end
        as reason, count(*) as rows from ({DOC_IDS}) group by 1""",
    "training_rows": f"""with {TRAINING} select conv_id, turn, {as_text('cut')} as input_ids, len(kept) > {TRAINING_MAX_LENGTH} as was_truncated,
        {as_text("list_transform(cut, lambda x, j: case when j > found + 1 then x else -100 end)")} as labels,
        case when found is null then 'no template' end as problem_found from l""",
    "extract_answers": f"""with f as (select o_orderkey as problem_id, case o_orderkey % 6
          when 0 then 'so \\boxed{{\\dfrac{{' || o_orderkey || '}}{{4}}}} done'
          when 1 then '\\boxed{{1}} then \\boxed{{\\text{{' || o_orderkey || '}} }}'
          when 2 then 'it is $' || o_orderkey || ',000.' when 3 then '\\boxed{{' || o_orderkey || ' and 12/5'
          when 4 then '\\boxed{{\\left( ' || o_orderkey || '.50 \\right)}}' else 'no answer' end as text from orders),
      a as (select problem_id, {answer('text')} as answer from f), n as (select *, {normal('answer')} as normal from a)
      select problem_id, answer, normal, round({number('normal')}, 6) as value from n""",
    "grade": f"with f2 as ({F2}), done as ({graded('f2', 'trace', 'is_correct')}) select problem_id, is_correct from done",
    "grade_against": f"""select {LINE}, l_orderkey % 97 = (l_orderkey + l_linenumber % 2) % 97 as is_correct from ({CANDIDATES})""",
    "graded_traces": f"with {GRADED_MORE} select problem_id, trace_af, is_raw_correct, is_af_correct from done",
    "trace_dataset": f"""with {BUILT_DONE}
      select problem_id, candidate, shard, {PROMPT} as prompt, solution, trace, round(ppl, 6) as trace_logppl, a::BIGINT as accept_rank,
        trace_af, is_raw_correct, is_af_correct from done""",
    "trace_dataset_plain": f"""with {PLAIN_STAGE} select problem_id, candidate, shard, prompt, round(ppl, 6) as trace_logppl,
        trace_af, is_raw_correct, is_af_correct from done""",
    "grade_edge_answers": f"""select o_orderkey as problem_id, ([{EDGES}])[(o_orderkey % {len(EDGE_CASES)})::INT + 1] as is_correct from orders""",
    "tokens_without_loss": r"""select doc_id, regexp_replace(lower(text), '[\x20\x09-\x0D]', '', 'g') as joined from documents""",
    "accuracy_intervals": f"""with f2 as ({F2}), raw as ({graded('f2', 'trace', 'is_raw_correct')}),
      h as (select problem_id, run, is_raw_correct::INT as ok, block, md5(problem_id || '|{SEED}|' || block) as h
        from raw, (select unnest(range(25)) as block)),
      n as (select run, ok, block * 8 + i as r, ('0x' || substr(h, 4 * i::INT + 1, 4))::INT as u from h, (select unnest(range(8)) as i)),
      w as (select run, r, ok, {' + '.join(f'(u >= {t})::INT' for t in THRESHOLDS)} as w from n),
      s as (select run, r, sum(w * ok)::DOUBLE / sum(w) as share from w group by run, r),
      d as (select s.run, s.share, s.share - b.share as gap from s join s b on b.r = s.r and b.run = '1-URGENT'),
      l as (select run, list_sort(list(share)) as shares, list_sort(list(gap)) as gaps from d group by run),
      a as (select run, count(*) as traces, avg(is_raw_correct::INT) as acc from raw group by run)
      select run, traces, round(acc, 6) as accuracy, round(shares[6], 6) as accuracy_low, round(shares[195], 6) as accuracy_high,
        round(acc - (select acc from a where run = '1-URGENT'), 6) as delta, round(gaps[6], 6) as delta_low,
        round(gaps[195], 6) as delta_high from a join l using (run)""",
    "defence_comparison": f"""with picks as ({drawn('clean', 'score')} union all {drawn('defended', 'score + 5.0::DOUBLE * (plus - minus)')}),
      a as (select o_orderpriority as split, run, count(*) as traces, avg((l_linenumber % 2 = 0)::INT) as acc
        from picks join orders on o_orderkey = l_orderkey group by all)
      select split, run, traces, round(acc, 6) as raw_accuracy,
        round(acc - max(case when run = 'clean' then acc end) over (partition by split), 6) as raw_accuracy_delta from a""",
    "undecided_groups": f"""select l_orderkey, count(*) as candidates from ({CANDIDATES}) group by l_orderkey
      having l_orderkey % 9 in (0, 3) or l_orderkey % 9 = 6 and bool_and(l_linenumber % 2 = 0)""",
    "score_other_corpus": f"""with {UNIGRAMS}, pairs as ({PAIRS}), r as (select conv_id, turn, unnest({words('response')}) as w2 from pairs),
      s as (select conv_id, turn, avg(-ln((coalesce(n, 0) + 1.0::DOUBLE) / (total + types))) as p from r left join m using (w2), z group by conv_id, turn)
      select conv_id, turn, round(coalesce(p, -1), 6) as logppl from pairs left join s using (conv_id, turn)""",
    "dataset_ablation": student_loss(1),
    "dataset_ablation_bigram": student_loss(2),
    "stored_settings": f"""with {BUILT_DONE} select 'gsm8k_train' as data_split, 0.5::DOUBLE as tau,
        round(avg(is_raw_correct::INT), 6) as "stats.raw_accuracy", count(*) as "stats.trace_len_stats.count" from done""",
    "trace_dataset_report": f"""with {BUILT}, s as (select shard, count(*) as n,
          min(case when ok and a = 500 then least(ceil(pos / 512.0::DOUBLE) * 512, n) end) as paid,
          sum((a - ok::INT < 500 and not ok)::INT) as rejected, sum((a - ok::INT < 500 and ok)::INT) as accepted from o group by shard)
      select shard::VARCHAR as shard, sum(coalesce(paid, n))::BIGINT as generated, sum(rejected)::BIGINT as rejected,
        sum(accepted)::BIGINT as accepted, bool_or(accepted < 500) as exhausted from s group by rollup (shard)""",
    "accuracy": ACCURACY,
    "compare_runs": f"""with {GRADED}, a as (select run, avg(is_raw_correct::INT) as raw, avg(is_af_correct::INT) as af from done group by run)
      select run, round(raw - (select raw from a where run = '1-URGENT'), 6) as raw_accuracy_delta,
        round(af - (select af from a where run = '1-URGENT'), 6) as af_accuracy_delta from a""",
    "global_rank": f"""select o_orderkey, o_totalprice, o_orderpriority,
        row_number() over (order by {seeded('o_orderkey')}, o_orderkey) as rank from orders""",
    "stored_rank": """select o_orderkey, o_totalprice, o_orderpriority,
        row_number() over (order by o_totalprice, o_orderkey) as rank from orders""",
    "split_seeded": f"""select o_orderkey, o_totalprice, o_orderpriority,
        case when row_number() over (order by {seeded('o_orderkey')}, o_orderkey) <= floor(count(*) over () * {TRAIN_FRACTION}::DOUBLE)
          then 'train' else 'holdout' end as split from orders""",
    "limit_n": "select o_orderkey, o_totalprice, o_orderpriority from orders order by o_orderkey limit 500",
    "shard_contiguous": """with r as (select *, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders),
      b as (select s.range as shard, s.range * (n // 7) + least(s.range, n % 7) as first,
          (s.range + 1) * (n // 7) + least(s.range + 1, n % 7) as past from (select count(*) as n from orders), range(7) as s)
      select o_orderkey, o_totalprice, o_orderpriority, shard::INT as shard from r join b on i >= first and i < past""",
    "shard_strided": """select o_orderkey, o_totalprice, o_orderpriority,
        ((row_number() over (order by o_orderkey) - 1) % 7)::INT as shard from orders""",
    "batch_plan": """with b as (select n_chars, (row_number() over (order by doc_id) - 1) // 64 as batch from documents)
      select batch, count(*) as rows, max(n_chars) as padded_length, sum(n_chars)::BIGINT as tokens,
        (count(*) * max(n_chars) - sum(n_chars))::BIGINT as padding, count(*) = 64 as is_full from b group by batch""",
    "example_rows": f"""select o_orderkey, o_totalprice, o_orderpriority from orders
        order by {seeded('o_orderkey')}, o_orderkey limit 20""",
    "rejection_sample": f"""with {REJECTION} select {LINE}, shard, round(price, 6) as price, a::BIGINT as accept_rank
        from o where ok and a <= 1000""",
    "rejection_report": f"with {REJECTION} select * from report",
    "rejection_lazy": f"""with {LAZY} select {LINE}, shard, round(price, 6) as price, a::BIGINT as accept_rank
        from o where ok and a <= 500""",
    "rejection_lazy_report": f"""with {LAZY}, s as (select shard, count(*) as n,
          min(case when ok and a = 500 then least(ceil(pos / 512.0::DOUBLE) * 512, n) end) as paid,
          sum((a - ok::INT < 500 and not ok)::INT) as rejected, sum((a - ok::INT < 500 and ok)::INT) as accepted from o group by shard)
      select shard::VARCHAR as shard, sum(coalesce(paid, n))::BIGINT as generated, sum(rejected)::BIGINT as rejected,
        sum(accepted)::BIGINT as accepted, bool_or(accepted < 500) as exhausted from s group by rollup (shard)""",
    "rejection_unplaced": f"""with c as ({CANDIDATES}), o as (select *, price <= 2.5::DOUBLE as ok,
        sum((price <= 2.5::DOUBLE)::INT) over (partition by shard order by {seeded(LINE)}, {LINE} rows unbounded preceding) as a
        from c where l_orderkey % 11 > 0)
      select 'placed' as part, sum((ok and a <= 500)::INT)::BIGINT as accepted, sum((not ok and a < 500)::INT)::BIGINT as rejected from o
      union all select 'unplaced', 0, count(*) from c where l_orderkey % 11 = 0""",
    "softmax_scores": f"with {SOFTMAX} select {LINE}, round(probability, 6) as probability from p",
    "softmax_greedy": f"""with c as ({CANDIDATES}) select {LINE}, (row_number() over (partition by l_orderkey
        order by score desc, {CANDIDATE}) = 1)::INT::DOUBLE as probability from c""",
    "nucleus": f"with {NUCLEUS} select {LINE}, round(share, 6) as probability from k",
    "sample_one": f"""with {NUCLEUS}, u as (select *, -ln(1 - ('0x' || substr({seeded(LINE)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)
          / share as wait from k),
      w as (select *, row_number() over (partition by l_orderkey order by wait) as place from u) select {LINE} from w where place = 1""",
    "rescore": f"select {LINE}, round(score + 5.0::DOUBLE * (plus - minus), 6) as adjusted from ({CANDIDATES})",
    "log_perplexity": f"""with {UNIGRAMS}, s as (select doc_id, avg(-ln((n + 1.0::DOUBLE) / (total + types))) filter (position >= 10) as p
        from x join m using (w2), z group by doc_id)
      select doc_id, round(coalesce(p, -1), 6) as logppl from documents left join s using (doc_id)""",
    "fit_unigram": f"with {UNIGRAMS} select w2, n, round(ln((n + 0.5::DOUBLE) / (total + 0.5::DOUBLE * types)), 6) as logp from m, z",
    "fit_bigram": f"with {BIGRAMS} select w1, w2, n from m",
    "score_bigram": f"""with {BIGRAMS}, s as (select doc_id, avg(-ln((n + 0.5::DOUBLE) / (given + 0.5::DOUBLE * types))) as p
        from x join m using (w1, w2) join cx using (w1), z group by doc_id)
      select doc_id, round(coalesce(p, -1), 6) as logppl from documents left join s using (doc_id)""",
    "cross_entropy_difference": f"""with d as ({DOC_TOKENS}), x as (select doc_id, unnest(tokens) as w2 from d),
      m as (select w2, count(*) filter (quality = 1) as plus, count(*) filter (quality = 0) as minus
        from x left join labels using (doc_id) group by w2),
      z as (select sum(plus) as p, sum(minus) as q, count(*) filter (plus + minus > 0) + 1 as types from m),
      s as (select doc_id, avg(ln((plus + 1.0::DOUBLE) / (p + types)) - ln((minus + 1.0::DOUBLE) / (q + types))) as v
        from x join m using (w2), z group by doc_id)
      select doc_id, round(v, 6) as difference from documents left join s using (doc_id)""",
    "cross_entropy_difference_bigram": f"""with {BIGRAMS},
      pm as (select w1, w2, count(*) filter (quality = 1) as plus, count(*) filter (quality = 0) as minus
        from x left join labels using (doc_id) group by all),
      pc as (select w1, sum(plus) as p, sum(minus) as q from pm group by w1),
      pz as (select count(distinct w2) + 1 as types from pm where plus + minus > 0),
      s as (select doc_id, avg(ln((plus + 1.0::DOUBLE) / (p + pz.types)) - ln((minus + 1.0::DOUBLE) / (q + pz.types))) as v
        from x join pm using (w1, w2) join pc using (w1), pz group by doc_id)
      select doc_id, round(v, 6) as difference from documents left join s using (doc_id)""",
    "vector_mean": """with x as (select label, vec_id % 5 + 1 as w, unnest(embedding)::DOUBLE as v,
          generate_subscripts(embedding, 1) - 1 as dim from embeddings)
      select label, dim::INT as dim, round(sum(w * v) / sum(w), 6) as value from x group by all""",
    "mean_vector_norms": """with x as (select label, vec_id % 5 + 1 as w, unnest(embedding)::DOUBLE as v,
          generate_subscripts(embedding, 1) as dim from embeddings),
      m as (select label, dim, sum(w * v) / sum(w) as v from x group by all)
      select label, round(sqrt(sum(v * v)), 6) as norm, round(sqrt(sum(v * v) / count(*)), 6) as rms, count(*) as elements
      from m group by label""",
    "vector_norms": """with x as (select vec_id, unnest(embedding)::DOUBLE as v from embeddings)
      select vec_id, round(sqrt(sum(v * v)), 6) as norm, round(sqrt(sum(v * v) / count(*)), 6) as rms, count(*) as elements
      from x group by vec_id""",
    "vector_norms_by_label": """with x as (select label, unnest(embedding)::DOUBLE as v from embeddings)
      select label, round(sqrt(sum(v * v)), 6) as norm, round(sqrt(sum(v * v) / count(*)), 6) as rms, count(*) as elements
      from x group by label""",
    "key_coverage": """select o_orderkey, 'left' as missing_from from orders anti join lineitem on l_orderkey = o_orderkey
      union all select distinct l_orderkey, 'right' from lineitem anti join orders on l_orderkey = o_orderkey""",
    "describe_lengths": f"select lang, {statistics('len(tokens)')} from ({DOC_TOKENS}) group by lang",
    "describe_all": f"select {statistics('l_extendedprice')} from lineitem",
    "flatten_struct": NESTED,
    "run_record": f"""with {BUILT_DONE}, measured as (select *, len({words('trace_af')}) as len from done),
      shards as (select shard, count(*) as n, min(case when ok and a = 500 then least(ceil(pos / 512.0::DOUBLE) * 512, n) end) as paid,
        sum((a - ok::INT < 500 and not ok)::INT) as rejected, sum((a - ok::INT < 500 and ok)::INT) as accepted,
        max(case when ok and a <= 500 then ppl end) as top, sum(case when ok and a <= 500 then ppl end) as total from o group by shard),
      report as (select sum(coalesce(paid, n))::BIGINT as generated, sum(rejected)::BIGINT as rejected, sum(accepted)::BIGINT as accepted,
        round(sum(accepted) / greatest(sum(coalesce(paid, n)), 1)::DOUBLE, 6) as acceptance_rate, {TRACE_THRESHOLD}::DOUBLE as threshold,
        true as all_below_threshold, round(max(top), 6) as max_accepted, round(sum(total) / sum(accepted), 6) as mean_accepted,
        bool_or(accepted < 500) as exhausted from shards)
      select 'gsm8k_train' as data_split, 2.0::DOUBLE as tau, s.*, r.* from
        (select round(avg(is_raw_correct::INT), 6) as "stats.raw_accuracy", round(avg(is_af_correct::INT), 6) as "stats.af_accuracy",
          {dotted('stats.trace_len_stats', 'len')}, {dotted('stats.ppl_stats', 'ppl')} from measured) s,
        (select {', '.join(f'{c} as "stats.rejection_sampling.{c}"' for c in (
            'generated', 'rejected', 'accepted', 'acceptance_rate', 'threshold', 'all_below_threshold',
            'max_accepted', 'mean_accepted', 'exhausted'))} from report) r""",
    "accepted_replies": f"""with pairs as ({PAIRS}), x as (select conv_id, turn, unnest({words('response')}) as w from pairs),
      m as (select w, count(*) as n from x group by w), z as (select sum(n) as total, count(*) + 1 as types from m),
      s as (select conv_id, turn, avg(-ln((n + 1.0::DOUBLE) / (total + types))) as logppl from x join m using (w), z group by all),
      o as (select *, conv_id % 4 as shard, sum(1) over (partition by conv_id % 4
          order by {seeded('conv_id, turn')}, conv_id, turn rows unbounded preceding) as a from s where logppl <= {REJECTION_THRESHOLD}::DOUBLE)
      select conv_id, turn, shard, round(logppl, 6) as logppl, a::BIGINT as accept_rank, problem, response
      from o join pairs using (conv_id, turn) where a <= 25""",
}
