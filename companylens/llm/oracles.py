"""DuckDB SQL of the training-data operators that SQL can express.

The others are compared with brute force in tests/llm: token ids, trained models, hashed
filters, markup and connected components have no SQL, and byte windows or shingles of whole
tables are too slow in it; the template patterns of op6 need look-behind, which DuckDB's
regular expressions lack.
"""

from __future__ import annotations

from companylens.llm import divergence as audit
from companylens.llm import quality_rules as rules

_WORDS = ", ".join(
    f"('{lang}', '{word}')" for lang, words in rules.COMMON_WORDS.items() for word in words
)
_LANGS = ", ".join(f"'{lang}'" for lang in rules.COMMON_WORDS)
_CLASSES = ["lower", "upper", "digit", "n_symbols", "mark", "other"]


def _kept(pattern: str) -> str:
    return f"length(regexp_replace(text, '{pattern}', '', 'g'))"


def _term(p: str, q: str) -> str:
    half = lambda a: f"case when {a} > 0 then {a} * log2(2 * {a} / ({p} + {q})) else 0 end"
    return f"(({half(p)}) + ({half(q)})) / 2"


_MARK = r"""[^!"''()+,\-./:;=?@\[\\\]^_`{}~]+"""
_SPACE = r"[\x20\x09-\x0D]+"

OP7 = f"""
with d as (select doc_id, lang, coalesce(text, '') as text from documents),
split as (select *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
measured as (select doc_id, lang, words, len(words) as n_words, {_kept(_SPACE)} as word_chars,
    {_kept('[^#*$%&|<>]+')} as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    {_kept('[^A-Z]+')} as upper, {_kept('[^0-9]+')} as digit, {_kept(_MARK)} as mark,
    {_kept('[\\x00-\\x7F]+')} as other from split),
words as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from measured),
windows as (select doc_id, i, word || chr(10) || lead(word) over w || chr(10) || lead(word, 2) over w as three
    from words window w as (partition by doc_id order by i)),
repeated as (select doc_id, i from windows where three is not null
    qualify count(*) over (partition by doc_id, three) > 1),
covered as (select doc_id, count(distinct i + k) as n_repeat_words from repeated, (values (0), (1), (2)) v(k) group by doc_id),
base as (select m.* exclude (words), coalesce(n_repeat_words, 0) as n_repeat_words,
    greatest(word_chars - upper - digit - n_symbols - mark - other, 0) as lower,
    n_words < {rules.MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {rules.REPEAT_PERCENT} * n_words as base_failed
    from measured m left join covered using (doc_id)),
common(lang, word) as (values {_WORDS}),
counts as (select doc_id, lower(word) as word, count(*) as n from words where lower(word) in (select word from common) group by all),
sound as (select * from base where not base_failed and lang in ({_LANGS})),
char_refs as (select lang, count(*) as docs, {', '.join(f'avg({c} / word_chars) as q_{c}' for c in _CLASSES)} from sound group by lang),
word_refs as (select c.lang, c.word, coalesce(sum(n / n_words), 0) / any_value(docs) as q
    from common c join char_refs using (lang) left join (select * from sound join counts using (doc_id)) s
      on s.lang = c.lang and s.word = c.word group by c.lang, c.word),
char_distance as (select doc_id, r.lang, sqrt(greatest({' + '.join(_term(f'({c} / word_chars)', f'q_{c}') for c in _CLASSES)}, 0)) as distance
    from base, char_refs r where n_words > 0),
pairs as (select b.doc_id, r.lang, coalesce(n / n_words, 0) as p, q from base b cross join word_refs r
    left join counts c on c.doc_id = b.doc_id and c.word = r.word where n_words > 0),
word_distance as (select doc_id, lang, sqrt(greatest(sum(case when p > 0 then {_term('p', 'q')} else q / 2 end)
    + {_term('(1 - sum(p))', '(1 - sum(q))')}, 0)) as distance from pairs group by doc_id, lang),
nearest as (select doc_id, min(greatest(c.distance / ({rules.CHAR_LIMIT} + {rules.CHAR_GUARD} / sqrt(n_words)),
    w.distance / ({rules.WORD_LIMIT} + {rules.WORD_GUARD} / sqrt(n_words)))) as excess
    from char_distance c join word_distance w using (doc_id, lang) join base using (doc_id) group by doc_id)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and (coalesce(lang not in ('', {_LANGS}), false) or coalesce(excess <= 1, true)) as kept
from base left join nearest using (doc_id)"""

OP13 = rf"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), '{audit.UPPER}', '{audit.UPPER.lower()}') as text from documents),
found as (select row, lang, source, unnest(regexp_extract_all(text, '{audit.TERM}')) as term from d),
kept as (select lang, term, count(*) as n from found group by lang, term
    having count(distinct row) >= {audit.MIN_DOCUMENTS}),
langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
cells as (select lang, source, term, count(*) as n from found semi join kept using (lang, term) group by all),
totals as (select lang, source, sum(n) as total from cells group by all),
groups as (select distinct lang, source from d),
shares as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    (1 + ({audit.SHARE_UNIT}::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v))::bigint as p,
    (1 + ({audit.SHARE_UNIT}::hugeint * (k.n + 2)) // (l.total + 2 * l.v))::bigint as q
    from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang
    left join totals t on t.lang = g.lang and t.source = g.source
    left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
    from shares a join shares b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
    from groups a join groups b on b.lang = a.lang and b.source <> a.source
    left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from shares where n > 0 and p > q)
select lang, source, 'pair' as part, item, value,
    (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select lang, source, 'term', item, value,
    (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms
    qualify row_number() over (partition by lang, source order by value desc, item) <= {audit.TOP_TERMS}"""

ORACLES = {"op7_divergence_quality": OP7, "op13_source_divergence": OP13}
