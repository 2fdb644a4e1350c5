"""SQL twins of those queries that SQL can express."""
from lexweave.llm import phrases, quality, urls

SQL: dict[str, str] = {}

SQL["op10_urls"] = f"""
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r(v, h, s) as (values {', '.join(str(x) for x in urls.RULES)}),
m as (
  select page_id, host, path, h || s as rule, v, row_number() over (partition by page_id, host, path order by length(h || s) desc nulls last, length(h) desc) as k
  from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where k = 1
"""

_WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))


def _fails(rules) -> str:
    def one(r: quality.Rule) -> str:
        whole = "1" if r.whole == "one" else r.whole
        tests = [f"{r.part} * 1000 < {whole} * {round(r.low * 1000)}"] if r.low is not None else []
        tests += [f"{r.part} * 1000 > {whole} * {round(r.high * 1000)}"] if r.high is not None else []
        return f"({whole} > 0 and ({' or '.join(tests)}))"
    return " or ".join(map(one, rules))


SQL["op8_quality_rules"] = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
w as (select k, doc_id, t, {_WORDS} as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select k, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
n as (select k, i, count(*) over (partition by k, ws[i], ws[i + 1], ws[i + 2]) as c from g),
r as (select k, count(distinct i + x.o) as n_repeat_words from n, (values (0), (1), (2)) x(o) where c > 1 group by k),
c as (
  select doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) as n_capitals,
         len(list_filter(ws, lambda v: lower(v) in ({_STOP}))) as n_stop
  from w left join r using (k)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_fails(quality.BASE)} as base_failed,
       not ({_fails(quality.BASE + quality.RULES)}) as kept from c
"""

SQL["op11_exact"] = r"""
with d as (select row_number() over () as k, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents),
m as (select *, row_number() over (partition by h order by doc_id nulls last, k) as place from d)
select doc_id, first_value(doc_id) over (partition by h order by place) as keep_id, count(*) over (partition by h) as group_size,
       place = 1 as kept, h as text_sha256 from m
"""

SQL["op12_phrases"] = rf"""
with d as (select coalesce(lang, '{phrases.UNKNOWN}') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
           from documents where text is not null),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
s as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w where len(ws) > 0),
e as (select lang, ws, i, unnest(range(1, least({phrases.LONGEST}, len(ws) - i + 1) + 1)) as m from s),
f as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, any_value(m) as m, count(*) as a from e group by 1, 2),
n as (select lang, sum(a) as n from f where m = 1 group by 1),
c as (select lang, phrase, string_split(phrase, ' ') as ws, m, a from f where m > 1 and a >= {phrases.LEAST}),
k as (select lang, phrase, ws, m, a, unnest(range(1, m)) as k from c),
x as (select k.lang, k.phrase, k.m, k.a, k.k, u.a as l, v.a as r, n.n,
             (1000::hugeint * k.a::hugeint * n.n::hugeint) // (u.a::hugeint * v.a::hugeint) as score
      from k join n using (lang) join f u on u.lang = k.lang and u.phrase = array_to_string(k.ws[1:k.k], ' ')
      join f v on v.lang = k.lang and v.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b as (select * from x qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select lang, a, ws, m, unnest(range(2, m)) as len from c),
q as (select lang, a, ws, len, unnest(range(1, m - len + 2)) as st from o),
g as (select lang, array_to_string(ws[st:st + len - 1], ' ') as phrase, max(a) as longer from q group by 1, 2),
z as (select b.* from b left join g using (lang, phrase) where longer is null or 100 * longer < {phrases.INSIDE} * a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from r where rank <= {phrases.KEEP}
"""
