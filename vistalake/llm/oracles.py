"""The operators that SQL can express, for DuckDB: each from the definition, not by the operator's method."""

from __future__ import annotations

from vistalake.llm.quality import ROUNDS, RULES, SYMBOLS
from vistalake.llm.secrets import CANDIDATE, CLASSES, KINDS, PLACEHOLDERS, WINDOW

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') as w from documents)"
#: A name that is a window's key in `quality` must not depend on word boundaries: words hold no space.
RUN = "array_to_string(w[i:i + {n} - 1], ' ')"

SUBSTRING = f"""with {WORDS},
  win as (select doc_id, i, md5({RUN.format(n=50)}) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
  least_id as (select h, min(doc_id) as m from win group by h),
  gone as (select distinct doc_id, unnest(range(i, i + 50)) as k from win join least_id using (h) where m < doc_id),
  words as (select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from w),
  kept as (select words.doc_id, string_agg(word, ' ' order by words.k) as text from words left join gone on words.doc_id = gone.doc_id and words.k = gone.k where gone.k is null group by words.doc_id)
  select w.doc_id, len(w)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
  from w left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id) left join kept using (doc_id)"""

JACCARD = f"""with recursive w as materialized (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACES}'), lambda x: x <> '') as w from documents),
  s as materialized (select distinct doc_id, md5(case when len(w) >= 5 then {RUN.format(n=5)} else array_to_string(w, ' ') end) as h
   from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
  n as materialized (select doc_id, count(*) as n from s group by doc_id),
  links as materialized (select a.doc_id as x, b.doc_id as y from s a join s b using (h) join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id where a.doc_id <> b.doc_id
   group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
  reach(id, label) as (select doc_id, doc_id from n union select l.y, r.label from reach r join links l on l.x = r.id where r.label < l.y)
  select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.label, w.doc_id) as component_id from w left join n using (doc_id) left join (select id, min(label) as label from reach group by id) c on c.id = w.doc_id"""


def quality_sql() -> str:
    names = list(RULES)
    vote = lambda m, good, bad: "case when {u} = 0 then 0 when {o} <= {g} * {u} then 1 when {o} >= {b} * {u} then -1 else 0 end".format(o=m.split(" / ")[0], u=m.split(" / ")[1], g=f"{good}::double", b=f"{bad}::double")
    votes = ", ".join(f"{vote(*RULES[r])} as v_{r}" for r in names)
    parts = [f"""{WORDS}, win as (select doc_id, i, md5({RUN.format(n=5)}) as h from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
  rep as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 5)) as k from (select *, count(*) over (partition by doc_id, h) as c from win) where c > 1) group by doc_id),
  lines as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
  m as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(coalesce(text, ''), '[{SYMBOLS}]'))::bigint as n_symbols,
   len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(regexp_extract_all(coalesce(text, ''), '[{SYMBOLS}]+')) as n_symbol_runs,
   len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) as n_upper, len(regexp_extract_all(coalesce(text, ''), '!')) as n_exclaims from documents d join w using (doc_id) join lines using (doc_id) left join rep using (doc_id)),
  voted as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {votes} from m),
  pat as materialized (select [{', '.join('v_' + r for r in names)}] as v, count(*)::double as n from voted group by all),
  sh0 as (select v, n, case when list_contains(v, -1) then 0.01 else 0.99 end::double as g from pat)"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""wt{r} as materialized (select t.k, x.val, case when x.val = -1 then least(ratio, 0) when x.val = 1 then greatest(ratio, 0) else 0 end as weight from (select unnest(range(1, {len(names) + 1})) as k) t, (select unnest([-1, 0, 1]) as val) x,
   lateral (select ln(coalesce(sum(n * g) filter (v[t.k] = x.val), 0) + 1) - ln(sum(n * g) + 3) - ln(coalesce(sum(n * (1 - g)) filter (v[t.k] = x.val), 0) + 1) + ln(sum(n * (1 - g)) + 3) as ratio from sh{r})),
  pr{r} as materialized (select ln(sum(n * g) + 1) - ln(sum(n * (1 - g)) + 1) as prior from sh{r}),
  sh{r + 1} as materialized (select v, n, 1 / (1 + exp(-((select prior from pr{r}) + (select sum(weight) from wt{r} where val = v[k])))) as g from pat)""")
    return f"""with {', '.join(parts)} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and g >= 0.5 as kept
  from voted join sh{ROUNDS + 1} on v = [{', '.join('v_' + r for r in names)}]"""


def secrets_sql() -> str:
    quote = lambda s: s.replace("'", "''")
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

    def spans(kind: int, pattern: str, group: int, shortest: int, d: str = "d") -> str:
        """Matches with a secret of `shortest` characters or more; shorter ones go before rows are made of them."""
        return f"""select doc_id, {kind} as kind, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) as start, list_sum(gaps[1:i]) + list_sum(sizes[1:i]) as stop, secrets[i] as secret from
   (select *, unnest(list_filter(range(1, len(secrets) + 1), lambda k: length(secrets[k]) >= {shortest})) as i from
     (select doc_id, list_transform(string_split_regex(t, '{quote(pattern)}'), lambda x: length(x)) as gaps, list_transform(regexp_extract_all(t, '{quote(pattern)}'), lambda x: length(x)) as sizes, regexp_extract_all(t, '{quote(pattern)}', {group}) as secrets from {d}))"""

    least = "case " + " ".join(f"when regexp_matches(secret, '{quote(p)}') then {h}" for _, p, h in CLASSES) + " end"
    allowed = "regexp_matches(secret, '^[^A-Za-z]*$') or (not regexp_matches(secret, '[0-9]') and length(secret) >= 3 * len(regexp_extract_all(secret, '[A-Z]?[a-z]+|[A-Z]+')))"
    plain = "t"
    for word in PLACEHOLDERS:
        plain = f"regexp_replace({plain}, '(?i){word}', '{' ' * len(word)}', 'g')"
    name = f"[{', '.join(repr(k) for k in KINDS)}][kind + 1]"
    text = f"string_agg(concat({name}, ':', start::varchar, ':', stop::varchar), ',' order by start, kind)"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
  base as materialized (select doc_id, kind, start::bigint as start, stop::bigint as stop from ({spans(0, assign, 1, 12)})
   union all select doc_id, kind, start, stop from ({spans(1, 'AKIA[A-Z0-9]+', 0, 18)}) union all select doc_id, kind, start, stop from ({spans(2, '[0-9a-f]+', 0, 16)})),
  cand as materialized (select doc_id, start, secret, {least} as least_bits from ({spans(3, CANDIDATE, 0, 20, f"(select doc_id, {plain} as t from d)")}) where not ({allowed})),
  wins as (select doc_id, start, least_bits, pos, substr(secret, pos::int + 1, {WINDOW}) as win from (select *, unnest(range(0, length(secret) - {WINDOW - 1})) as pos from cand)),
  chars as (select doc_id, start, least_bits, pos, c, count(*) as n from (select *, unnest(string_split(win, '')) as c from wins) where c <> '' group by all),
  dense as (select doc_id, start, pos from chars group by doc_id, start, pos, least_bits having log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} >= least_bits - 1e-9),
  more as (select doc_id, 3 as kind, (start + min(pos))::bigint as start, (start + max(pos) + {WINDOW})::bigint as stop from dense group by doc_id, dense.start),
  every as (select * from base union all select * from more m where not exists (select 1 from base b where b.doc_id = m.doc_id and b.start <= m.start and b.stop >= m.stop)),
  b as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, {text} as s from base group by doc_id),
  e as (select doc_id, {text} as s from every group by doc_id)
  select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b.s, '')) as base_sha256, coalesce(e.s, '') as spans from d left join b using (doc_id) left join e using (doc_id)"""


AUDIT_LETTERS = "ABCDE"
AUDIT = f"""with recursive {WORDS}, t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
  lab as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
  least_id as (select t, min(doc_id) as m from t group by t),
  fails as (select t.doc_id, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t.t, '[A-Z]')) > 5 * length(t.t), regexp_matches(t.t, '[#$%&*|]'), m < t.doc_id] as f
   from t join w using (doc_id) join least_id on least_id.t = t.t left join lab on lab.doc_id = t.doc_id),
  cells as materialized (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by all),
  letters as (select unnest(range(1, 6)) as k, unnest(string_split('{AUDIT_LETTERS}', '')) as letter),
  orders(filter_order, used) as (select '', []::bigint[] union all select concat(filter_order, letter), list_append(used, k) from orders, letters where not list_contains(used, k)),
  steps as (select filter_order, used, unnest(range(1, 6)) as step from orders where len(used) = 5),
  done as (select part, filter_order, step, used[step] as k, n, good, toxic, f, list_filter(used, lambda x: f[x])[1] as gone_by from steps, cells),
  sums as (select part, filter_order, step, k, coalesce(sum(n) filter (gone_by is null or list_position(string_split(filter_order, ''), substr('{AUDIT_LETTERS}', gone_by::int, 1)) > step), 0)::bigint as kept,
   coalesce(sum(n) filter (gone_by = k), 0)::bigint as removed, coalesce(sum(n) filter (f[k] and gone_by <> k), 0)::bigint as redundant, coalesce(sum(n) filter (f[k] and len(list_filter(f, lambda x: x)) = 1), 0)::bigint as unique_fails,
   coalesce(sum(good) filter (gone_by = k), 0)::bigint as good_lost, coalesce(sum(toxic) filter (gone_by = k), 0)::bigint as toxic_lost from done group by all)
  select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, k))::bigint as shapley from sums"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = f"""with d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as terms from documents),
  q as materialized (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) as term from benchmark),
  c as (select count(*) as docs, sum(len(terms)) as total from d where len(terms) > 0),
  tf as materialized (select doc_id, n, term, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as term from d) where term in (select term from q) group by all),
  w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, c group by term),
  scored as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint as score from tf join w using (term) join q using (term), c group by item_id, doc_id)
  select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10"""


ORACLE = {"op1_substring_dedup": SUBSTRING, "op4_quality_rules": quality_sql(), "op7_ngram_jaccard_join": JACCARD, "op9_secret_scan": secrets_sql(),
          "op12_filter_interaction": AUDIT, "op13_lexical_search": SEARCH}
