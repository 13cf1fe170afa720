"""The compiler restated as one chain of DuckDB common table expressions; each query reads the link it needs."""

from __future__ import annotations

from ..functions.effects import BLOCKING_IPS, LOCAL_NAMES
from ..functions.modifiers import FLAGS, KNOWN, SCOPED, SPECIAL, VALUED
from ..functions.syntax import LABEL, UNSUPPORTED
from .corpus import SQL as CORPUS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


#: The public suffixes under which the corpus' hosts fall.
SUFFIXES = ("com", "net", "org", "co.uk", "uk", "autos", "xyz")
_ATOM = r"""\\[\s\S]|\\$|'(?:[^'\\]|\\[\s\S])*(?:'|\\?$)|"(?:[^"\\]|\\[\s\S])*(?:"|\\?$)"""
_BALANCED = r"""^(?:[^'"\\]|\\[\s\S]|'(?:[^'\\]|\\[\s\S])*'|"(?:[^"\\]|\\[\s\S])*")*$"""
_HEAD = r"^(?:@@)?/(?:[^/\\]|\\[\s\S])*/"


def _split(text: str, sep: str) -> str:
    return f"regexp_extract_all({q(sep[-1])} || {text}, {q(sep + '((?:[^' + chr(39) + chr(34) + chr(92) * 2 + sep + ']|' + _ATOM + ')*)')}, 1)"


def _syntax(line: str, source: str, name: str) -> str:
    """CTEs that add pattern, modifier_text, names, is_exception, is_invalid, has_url_path and kind to a table with a stripped line."""
    return f"""
{name}1 AS (SELECT *, regexp_extract({line}, {q(_HEAD)}, 0) AS head, regexp_extract({line}, '[^$]*$', 0) AS aft FROM {source}),
{name}2 AS (SELECT *, CASE WHEN head <> '' THEN CASE WHEN substr({line}, length(head) + 1, 1) = '$' THEN head ELSE {line} END
    WHEN contains({line}, '$') THEN substr({line}, 1, length({line}) - length(aft) - 1) ELSE {line} END AS pattern,
  nullif(CASE WHEN head <> '' THEN CASE WHEN substr({line}, length(head) + 1, 1) = '$' THEN substr({line}, length(head) + 2) END
    WHEN contains({line}, '$') THEN aft END, '') AS modifier_text FROM {name}1),
{name}3 AS (SELECT *, starts_with(pattern, '@@') AS is_exception, CASE WHEN starts_with(pattern, '@@') THEN substr(pattern, 3) ELSE pattern END AS cand,
  pattern <> '' AND regexp_extract(pattern, {q(_HEAD)}, 0) = pattern AS is_rx,
  coalesce(list_distinct(list_filter(list_transform(string_split(modifier_text, ','), lambda p: regexp_replace(lower(trim(split_part(p, '=', 1))), '^~', '')), lambda n: n <> '')), []) AS names FROM {name}2),
{name}4 AS (SELECT *, cand IN ('', '||', '||^') AS is_invalid,
  CASE WHEN is_rx THEN false WHEN contains(cand, '://') THEN true
    WHEN starts_with(cand, '||') THEN strpos(substr(cand, 3), '/') > 0 AND (strpos(substr(cand, 3), '^') = 0 OR strpos(substr(cand, 3), '/') < strpos(substr(cand, 3), '^'))
    ELSE contains(cand, '/') END AS has_url_path FROM {name}3),
{name} AS (SELECT *, CASE WHEN is_invalid THEN 'invalid' WHEN starts_with(cand, '||') THEN 'abp' WHEN is_rx THEN 'regex'
    WHEN regexp_matches(pattern, '^[0-9.:a-fA-F]+\\s+\\S') THEN 'hosts' WHEN regexp_matches(pattern, {q(f'^{LABEL}(?:[.]{LABEL})*$')}) THEN 'plain_domain' ELSE 'other' END AS kind FROM {name}4)""".replace("\\\\s", "\\s").replace("\\\\S", "\\S")


_LOCAL = listed(LOCAL_NAMES)
_norm = lambda x: f"rtrim(trim(lower({x})), '.')"
_before = lambda parts: f"CASE WHEN list_position(list_transform({parts}, lambda z: starts_with(z, '#')), true) > 0 THEN ({parts})[1:list_position(list_transform({parts}, lambda z: starts_with(z, '#')), true) - 1] ELSE {parts} END"
_tokens = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda z: z <> '')"
_vals = "m.negated::VARCHAR || array_to_string(list_transform(m.vals, lambda v: chr(2) || v.negated::VARCHAR || chr(3) || v.value), '')"


def _never(mods: str) -> str:
    names = f"list_filter(list_transform({mods}, lambda m: m.name), lambda n: n <> '')"
    return f"(len(list_filter({mods}, lambda m: m.uncertain)) > 0 OR len({names}) <> len(list_distinct({names})) OR len(list_filter({names}, lambda n: NOT list_contains({listed(KNOWN)}, n) OR list_contains({listed(SPECIAL)}, n))) > 0)"


def _first(name: str) -> str:
    return f"list_transform(list_filter(mods, lambda m: m.name = '{name}'), lambda m: {_vals})[1]"


_SCOPE = f"""len(mods) = 0 AS m_none, {_never('mods')} AS m_never,
  len(list_filter(mods, lambda m: m.name <> 'important')) = 0 AS x_none, {_never("list_filter(mods, lambda k: k.name <> 'important')")} AS x_never,
  {_first('important')} AS m_important, {_first('client')} AS m_client, {_first('ctag')} AS m_ctag, {_first('dnstype')} AS m_dnstype,
  len(list_filter(mods, lambda m: m.name = 'important')) = 1 AND len(list_filter(mods, lambda m: m.name = 'important' AND NOT m.negated AND NOT m.uncertain AND m.raw_value IS NULL)) = 1 AS x_urgent,
  len(list_filter(mods, lambda m: m.name = 'important')) = 0 OR (len(list_filter(mods, lambda m: m.name = 'important')) = 1 AND len(list_filter(mods, lambda m: m.name = 'important' AND NOT m.negated AND NOT m.uncertain AND m.raw_value IS NULL)) = 1) AS x_safe"""
_NARROW = " AND ".join(f"(t.{c} IS NULL OR coalesce(t.{c} = p.{c}, false))" for c in ("m_client", "m_ctag", "m_dnstype"))
_COVERS = f"((t.m_none AND p.m_none) OR (NOT t.m_never AND NOT p.m_never AND t.m_important IS NOT DISTINCT FROM p.m_important AND {_NARROW}))"
_EXC_COVERS = f"(t.x_safe AND p.x_safe AND (NOT p.x_urgent OR t.x_urgent) AND ((t.x_none AND p.x_none) OR (NOT t.x_never AND NOT p.x_never AND {_NARROW})))"
_scope_names = "m_none, m_never, x_none, x_never, m_important, m_client, m_ctag, m_dnstype, x_urgent, x_safe"

CLEANED = f"""corpus AS ({CORPUS}),
c1 AS (SELECT *, trim(raw, ' ' || chr(9)) AS s FROM corpus),
c2 AS (SELECT *, CASE WHEN contains(s, '$') AND contains(regexp_extract(s, '[^$]*$', 0), '#') THEN s ELSE rtrim(regexp_replace(s, '\\s+#\\s+[^\\n]*$', '')) END AS t FROM c1),
{_syntax('t', 'c2', 'cs')},
cleaned AS (SELECT ord, src, h, parent, raw,
  CASE WHEN s = '' THEN 'empty' WHEN starts_with(s, '#') OR starts_with(s, '!') THEN 'comment'
    WHEN regexp_matches(s, '(?i)#[@$?%]*#|\\$#|\\[adblock') THEN 'cosmetic'
    WHEN list_has_any(names, {listed(UNSUPPORTED)}) THEN 'unsupported_modifier' WHEN has_url_path THEN 'url_path' WHEN is_invalid THEN 'invalid' END AS discard_reason,
  t, length(s) <> length(raw) OR length(t) <> length(s) AS shorter FROM cs)"""

CLASSIFIED = f"""{CLEANED},
lines AS (SELECT ord, t AS line FROM cleaned WHERE discard_reason IS NULL),
{_syntax('line', 'lines', 'syn')},
m1 AS (SELECT *, coalesce(list_transform({_split('modifier_text', ',')}, lambda c: {{'raw': trim(c), 'head': lower(trim(split_part(trim(c), '=', 1)))}}), []) AS chunks,
  NOT regexp_matches(coalesce(modifier_text, ''), {q(_BALANCED)}) AS loose FROM syn),
m2 AS (SELECT *, list_transform(chunks, lambda c: {{'name': CASE WHEN starts_with(c.head, '~') THEN trim(substr(c.head, 2)) ELSE c.head END, 'raw': c.raw, 'negated': starts_with(c.head, '~'),
  'raw_value': CASE WHEN contains(c.raw, '=') THEN substr(c.raw, strpos(c.raw, '=') + 1) END}}) AS named FROM m1),
m3 AS (SELECT *, list_transform(named, lambda m: {{'name': m.name, 'raw': m.raw, 'negated': m.negated, 'raw_value': m.raw_value,
  'parts': coalesce(list_transform({_split('m.raw_value', chr(92) + '|')}, lambda v: {{'raw': trim(v), 'bare': CASE WHEN starts_with(trim(v), '~') THEN substr(trim(v), 2) ELSE trim(v) END}}), []) }}) AS valued FROM m2),
m4 AS (SELECT *, list_transform(valued, lambda m: {{'name': m.name, 'raw': m.raw, 'negated': m.negated, 'raw_value': m.raw_value,
  'vals': list_transform(m.parts, lambda v: {{'negated': starts_with(v.raw, '~'), 'value': CASE WHEN m.name = 'dnstype' THEN upper(v.bare)
     ELSE regexp_replace(CASE WHEN length(v.bare) >= 2 AND v.bare[1] IN (chr(39), chr(34)) AND v.bare[1] = v.bare[-1] THEN v.bare[2:-2] ELSE v.bare END, '\\\\([\\s\\S])', '\\1', 'g') END}}),
  'uncertain': loose OR NOT list_contains({listed(KNOWN)}, m.name) OR (m.raw_value IS NULL AND list_contains({listed(VALUED)}, m.name))
     OR (m.raw_value IS NOT NULL AND (list_contains({listed(FLAGS)}, m.name) OR NOT regexp_matches(m.raw_value, {q(_BALANCED)}) OR len(list_filter(m.parts, lambda v: v.bare = '')) > 0))}}) AS mods FROM m3),
m5 AS (SELECT *, list_distinct(list_filter(list_transform(mods, lambda m: m.name), lambda n: n <> '')) AS mod_names,
  array_to_string(list_sort(list_transform(mods, lambda m: m.name || chr(1) || (m.raw_value IS NOT NULL)::VARCHAR || chr(1) || {_vals} || chr(1) || CASE WHEN m.uncertain THEN '?' || m.raw ELSE '' END)), chr(4)) AS sig FROM m4),
m6 AS (SELECT *, list_sort(list_filter(mod_names, lambda n: list_contains({listed(SCOPED)}, n))) AS scoped, list_contains(mod_names, 'important') AS urgent,
  {_tokens('pattern')} AS toks FROM m5),
m7 AS (SELECT *, len(scoped) > 0 OR urgent AS open_, CASE WHEN len(scoped) > 0 THEN 'scoped_apex_and_subdomains' ELSE 'apex_and_subdomains' END AS sc,
  CASE WHEN len(scoped) > 0 THEN 'known_scoped_modifier:' || array_to_string(scoped, ',') || ';no_global_coverage_proof' WHEN urgent THEN 'known_priority_modifier:important;no_structural_pruning_proof' ELSE 'abp_basic_apex_and_subdomains' END AS why,
  CASE WHEN len(toks) >= 2 AND (list_contains({listed(BLOCKING_IPS)}, toks[1]) OR starts_with(toks[1], '0.') OR starts_with(toks[1], '127.'))
    THEN list_filter(list_transform({_before('toks[2:]')}, lambda d: {_norm('d')}), lambda d: d <> '' AND NOT list_contains({_LOCAL}, d)) ELSE [] END AS hnames FROM m6),
m8 AS (SELECT *, CASE WHEN is_invalid THEN 1 WHEN has_url_path THEN 2 WHEN len(list_filter(mods, lambda m: m.uncertain OR NOT list_contains({listed(KNOWN)}, m.name))) > 0 THEN 3 WHEN list_contains(mod_names, 'badfilter') THEN 4
  WHEN is_exception AND kind = 'regex' THEN 5 WHEN is_exception AND kind <> 'abp' THEN 6 WHEN is_exception THEN 7 WHEN list_contains(mod_names, 'dnsrewrite') THEN 8 WHEN kind = 'abp' THEN 9 WHEN kind = 'regex' THEN 10
  WHEN kind = 'hosts' AND len(hnames) = 0 THEN 11 WHEN kind = 'plain_domain' AND list_contains({_LOCAL}, {_norm('pattern')}) THEN 12 WHEN kind IN ('hosts', 'plain_domain') THEN 13 ELSE 14 END AS rule_no FROM m7),
classified AS (SELECT *, CASE rule_no WHEN 1 THEN 'ignored' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'disable' WHEN 5 THEN 'exception' WHEN 6 THEN 'exception' WHEN 7 THEN 'exception' WHEN 8 THEN 'rewrite' WHEN 11 THEN 'ignored' WHEN 12 THEN 'ignored' WHEN 14 THEN 'uncertain' ELSE 'block' END AS effect,
  CASE WHEN rule_no IN (1, 2, 11, 12) THEN 'none' WHEN rule_no = 3 THEN 'unsupported_modifier' WHEN rule_no = 4 THEN 'apex_and_subdomains' WHEN rule_no IN (5, 10) THEN 'regex' WHEN rule_no IN (6, 14) THEN 'uncertain' WHEN rule_no IN (7, 8, 9) THEN sc ELSE 'exact_host' END AS scope,
  CASE rule_no WHEN 1 THEN 'invalid_syntax' WHEN 2 THEN 'url_path_not_dns_rule' WHEN 3 THEN 'unsupported_or_uncertain_modifier' WHEN 4 THEN 'badfilter_disables_matching_basic_rules' WHEN 5 THEN 'regex_exception_preserved_dns_rule_no_structural_pruning_proof'
    WHEN 6 THEN 'exception_scope_unproven' WHEN 7 THEN CASE WHEN open_ THEN 'exception_scope_unproven;' || why ELSE why END WHEN 8 THEN CASE WHEN open_ THEN 'dnsrewrite_custom_response;' || why ELSE 'dnsrewrite_custom_response' END
    WHEN 9 THEN why WHEN 10 THEN 'regex_preserved_dns_rule_no_structural_pruning_proof' WHEN 11 THEN 'hosts_rule_without_blocking_domain' WHEN 12 THEN 'local_hostname_ignored' WHEN 13 THEN 'agh_exact_host_baseline;project_policy_promotes_to_abp' ELSE 'unclassified_dns_rule_syntax' END AS reason,
  CASE WHEN rule_no IN (11, 12) THEN 'adguard_home_hosts_blocklists' WHEN rule_no = 13 THEN 'adguard_home_hosts_blocklists;project_policy' ELSE 'adguard_dns_filtering_syntax' END AS docs_source,
  CASE WHEN rule_no IN (2, 3, 5, 6, 10, 14) THEN true WHEN rule_no IN (7, 8, 9) THEN open_ ELSE false END AS uncertain FROM m8)"""

_ABP = r"^(@@)?\|\|(\*\.)?([^\^$|*\s]+)\^"
_HOSTS = r"^([0-9.:a-fA-F]+)\s+(.+)$"
ROUTED = f"""{CLASSIFIED},
r1 AS (SELECT *, {_norm(f"regexp_extract(pattern, {q(_ABP)}, 3)")} AS abp_domain, regexp_extract(pattern, {q(_ABP)}, 2) <> '' AS abp_wildcard,
  regexp_extract(line, {q(_HOSTS)}, 1) AS ip, {_tokens(f"regexp_extract(line, {q(_HOSTS)}, 2)")} AS rest FROM classified),
r2 AS (SELECT *, CASE WHEN NOT starts_with(line, '||') AND NOT starts_with(line, '@@') AND (list_contains({listed(BLOCKING_IPS)}, ip) OR starts_with(ip, '0.') OR starts_with(ip, '127.'))
  THEN list_filter(list_transform(list_filter({_before('rest')}, lambda d: regexp_matches(d, '^[a-zA-Z0-9][\\p{{L}}\\p{{N}}_.-]*$')), lambda d: {_norm('d')}), lambda d: d <> '' AND NOT list_contains({_LOCAL}, d)) ELSE [] END AS hdomains FROM r1),
routed AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN has_url_path OR is_invalid THEN 'malformed' WHEN effect IN ('rewrite', 'disable', 'ignored', 'unsupported') THEN 'nonblocking'
  WHEN (starts_with(line, '||') OR starts_with(line, '@@||')) AND abp_domain = '' THEN 'malformed' WHEN starts_with(line, '@@||') THEN 'exception' WHEN starts_with(line, '||') THEN 'abp' WHEN starts_with(line, '@@') THEN 'dropped'
  WHEN len(hdomains) > 0 THEN 'hosts' WHEN regexp_matches(line, {q(f'^{LABEL}(?:[.]{LABEL})*$')}) THEN 'plain' WHEN starts_with(line, '/') OR contains(line, '|') OR contains(line, '*') THEN 'other' ELSE 'dropped' END AS route FROM r2)"""

RECORDS = f"""{ROUTED},
direct AS (SELECT ord, 0 AS tok, line AS rule, abp_domain AS domain, abp_wildcard AS is_wildcard, route = 'exception' AS is_exception, false AS promoted, sig, mods FROM routed WHERE route IN ('abp', 'exception')),
named AS (SELECT ord, unnest(generate_series(0, len(ds) - 1)) AS tok, unnest(ds) AS domain, mods FROM (SELECT ord, mods, CASE WHEN route = 'plain' THEN [{_norm('line')}] ELSE hdomains END AS ds FROM routed WHERE route IN ('hosts', 'plain'))),
records AS (SELECT * FROM direct UNION ALL SELECT ord, tok, '||' || domain || '^', domain, false, false, true, '', [] FROM named),
scoped AS (SELECT *, {_SCOPE} FROM records),
excs AS (SELECT * FROM scoped WHERE is_exception),
rules AS (SELECT *, row_number() OVER (PARTITION BY domain, is_wildcard, sig ORDER BY ord, tok) AS nth FROM scoped WHERE NOT is_exception),
suf AS (SELECT DISTINCT domain, string_split(domain, '.') AS labels FROM rules),
suf2 AS (SELECT domain, labels, (SELECT max(len(string_split(x, '.'))) FROM (SELECT unnest({listed(SUFFIXES)}) AS x) WHERE domain = x OR ends_with(domain, '.' || x)) AS k FROM suf),
suf3 AS (SELECT domain, array_to_string(labels[len(labels) - k + 1:], '.') AS tld, CASE WHEN len(labels) > k THEN array_to_string(labels[len(labels) - k:], '.') END AS registered,
  CASE WHEN len(labels) - k - 1 >= 1 THEN list_transform(generate_series(1, len(labels) - k - 1), lambda i: array_to_string(labels[i + 1:], '.')) ELSE [] END AS parents FROM suf2),
kept AS (SELECT r.*, s.tld, s.registered, s.parents, CASE WHEN is_wildcard THEN '*.' || domain ELSE domain END AS storage_key,
  CASE WHEN is_wildcard AND coalesce(s.tld = domain, false) THEN 'tld_wildcard' ELSE 'abp' END AS section FROM rules r JOIN suf3 s USING (domain) WHERE nth = 1)"""

JUDGED = f"""{RECORDS},
tgt AS (SELECT CASE WHEN section = 'tld_wildcard' THEN 't:' || tld ELSE 'r:' || storage_key END AS key, ord AS t_ord, tok AS t_tok, false AS t_wild, {_scope_names} FROM kept
  UNION ALL SELECT 'x:' || domain, ord, tok, is_wildcard, {_scope_names} FROM excs),
prb0 AS (SELECT ord, tok, section, is_wildcard, domain, tld, {_scope_names}, unnest(parents) AS anc, unnest(generate_series(0, len(parents) - 1)) AS lvl FROM kept WHERE len(parents) > 0),
prb AS (SELECT ord, tok, is_wildcard, -3 AS place, 'x:' || domain AS key, true AS own, {_scope_names} FROM kept
  UNION ALL SELECT ord, tok, is_wildcard, -3, 'x:' || anc, false, {_scope_names} FROM prb0
  UNION ALL SELECT ord, tok, is_wildcard, -2, 't:' || tld, false, {_scope_names} FROM kept WHERE section = 'abp' AND tld <> domain
  UNION ALL SELECT ord, tok, is_wildcard, -1, 'r:' || domain, false, {_scope_names} FROM kept WHERE section = 'abp' AND is_wildcard
  UNION ALL SELECT ord, tok, is_wildcard, 2 * lvl, 'r:' || anc, false, {_scope_names} FROM prb0 WHERE section = 'abp'
  UNION ALL SELECT ord, tok, is_wildcard, 2 * lvl + 1, 'r:*.' || anc, false, {_scope_names} FROM prb0 WHERE section = 'abp'),
hit AS (SELECT p.ord, p.tok, p.place, t.t_ord, t.t_tok, CASE WHEN p.place = -3 THEN {_EXC_COVERS} ELSE {_COVERS} END AS ok
  FROM prb p JOIN tgt t USING (key) WHERE NOT (p.place = -3 AND t.t_wild AND p.own AND NOT p.is_wildcard)),
found AS (SELECT ord, tok, min(CASE WHEN ok THEN [place, t_ord, t_tok] END) AS sure, min(CASE WHEN NOT ok THEN [place, t_ord, t_tok] END) AS maybe, min(CASE WHEN place = -2 THEN t_ord END) AS tld_o FROM hit GROUP BY ord, tok),
judged AS (SELECT k.*, f.sure, f.maybe, f.tld_o, CASE WHEN sure[1] = -3 THEN 'exception_covered' WHEN section = 'tld_wildcard' THEN NULL WHEN sure[1] = -2 THEN 'tld_wildcard_covered' WHEN sure[1] = -1 OR sure[1] % 2 = 0 THEN 'parent_covered'
  WHEN sure IS NOT NULL THEN 'wildcard_covered' WHEN maybe IS NOT NULL THEN 'kept_because_uncertain' END AS verdict FROM kept k LEFT JOIN found f ON k.ord = f.ord AND k.tok = f.tok),
others AS (SELECT line, min(ord) AS ord, any_value(kind) AS kind FROM routed WHERE route = 'other' GROUP BY line)"""


def using(chain: str, query: str) -> str:
    return f"WITH {chain}\n{query}"
