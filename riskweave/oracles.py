"""The engine's results in DuckDB SQL, over the documents that the rendered diffs hold: views, rules, suppressions, entropy,
metrics, scores and reports, as common table expressions that the oracles of `queries` end with."""

from __future__ import annotations

from riskweave.functions import paths
from riskweave.functions.catalog import RULES, SEQUENCE
from riskweave.functions.catalog_values import LINE_RULES
from riskweave.functions.dialect import spaces, translate
from riskweave.functions.scalars import WEIGHTS
from riskweave.operators import entropy, lex, score
from riskweave.operators.metrics import DECISION_WORDS
from riskweave.operators.suppress import DEFAULT_PREFIX, directive_pattern
from riskweave.rendered import SQL as BASE
from riskweave.rendered import literal

WS = spaces(java=False)
CAPS = {r["id"]: r["cap"] for r in LINE_RULES} | {"entropy-secret": next(r["cap"] for r in RULES if r["id"] == "entropy-secret")}
SEVERITY = "case r when 0 then 'info' when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end"


def same(a: str, b: str) -> str:
    return f"{a} is not distinct from {b}"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


def units(x: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def shown(x: str) -> str:
    wide = f"replace({x}, chr(9), '  ')"
    return f"case when {units(wide)} <= 160 then {wide} else {wide}[1:159] || '…' end"


def number(x: str) -> str:
    return f"case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else cast({x} as varchar) end"


def tenth(x: str) -> str:
    return f"floor({x} * 10 + 0.5) / 10"


def half(x: str) -> str:
    return f"cast(floor({x} + 0.5) as bigint)"


def any_of(col: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches({col}, {literal(p)})" for p in patterns) + ")"


_FLAGS = ", ".join([
    *(f"coalesce({any_of('path', v)}, false) as {k}" for k, v in paths.PATTERNS.items()), f"coalesce(base in ({', '.join(map(literal, paths.MANIFESTS))}), false) as is_manifest",
    f"coalesce({any_of('base', paths.SECRET_BASE)} or {any_of('path', [paths.SECRET_PATH])}, false) as is_secret_file", f"coalesce({any_of('base', [paths.LOCK_BASE])}, false) as is_lockfile",
])
FLAGGED = BASE + f""",
based as (select *, lower(list_extract(string_split(path, '/'), -1)) as base from file),
flagged as (select *, {_FLAGS} from based)"""


def _starts(heads: list[str]) -> str:
    return "(" + (" or ".join(f"starts_with(s, {literal(h)})" for h in heads) or "false") + ")"


def _streams(name: str) -> str:
    """Select of one syntax family: its files' added lines as streams of code, strings, comments and open ends."""
    line, block, quotes = lex.FAMILIES[name]
    pattern = lex.segment_pattern(name).replace("*+", "*").replace("++", "+")
    segments = "[joined]" if name == "prose" else f"regexp_extract_all(joined, {literal(pattern)}, 1)"
    comment = f"({_starts(line)} or {_starts([a for a, _ in block])})"
    string = f"({_starts(quotes)} and not {comment})"
    closed = " or ".join(f"regexp_matches(s, {literal('^' + lex.closed_string(q).replace('*+', '*') + chr(92) + 'z')})" for q in quotes) or "false"
    blank = "regexp_replace(regexp_replace(s, '[\\x{10000}-\\x{10FFFF}]', '  ', 'g'), '[^\\n]', ' ', 'g')"
    newlines = "regexp_replace(s, '[^\\n]', '', 'g')"
    inner = "s"
    for a, b in block:
        text = f"case when ends_with(s, {literal(b)}) and length(s) >= {len(a) + len(b)} then s[{len(a) + 1}:length(s) - {len(b)}] else s[{len(a) + 1}:] end"
        inner = f"case when starts_with(s, {literal(a)}) then replace({text}, chr(10), chr(1) || chr(10)) || chr(1) else {inner} end"
    inner = f"case when {_starts(line)} then s || chr(1) else {inner} end"
    body = f"case when {closed} then s[2:length(s) - 1] else s[2:] end"
    join = lambda x: f"array_to_string(list_transform(segs, lambda s: {x}), '')"
    families = {**{x: n for n, v in lex.LANGUAGE_FAMILY.items() for x in v}}
    mine = [x for x, n in families.items() if n == name]
    where = f"language in ({', '.join(map(literal, mine))})" if name != "generic" else f"language not in ({', '.join(map(literal, families))})"
    return f"""select diff_id, file_idx, raws, nos, {join(f"case when {comment} or {string} then {blank} else s end")} as code, {join(f"case when {string} then ({body}) || chr(1) else {newlines} end")} as strings,
        {join(f"case when {comment} then {inner} else {newlines} end")} as comments, {join(f"case when {string} and not ({closed}) then 'U' else {newlines} end")} as opens
        from (select *, {segments} as segs from joined where {where})"""


_cut = lambda c: f"list_extract(string_split({c}, chr(10)), i)"
_stripped = lambda c: f"regexp_replace({c}, '\\x01\\z', '')"
VIEWS = FLAGGED + f""",
joined as (select diff_id, file_idx, any_value(language) as language, list(text order by j) as raws, list(new_no order by j) as nos, string_agg(text, chr(10) order by j) as joined from line where type = 'add' group by diff_id, file_idx),
streams as ({" union all ".join(_streams(name) for name in lex.FAMILIES)}),
cut as (select *, unnest(generate_series(1, len(raws))) as i from streams),
split as (select diff_id, file_idx, cast(i - 1 as integer) as added_idx, list_extract(nos, i) as n, list_extract(raws, i) as raw, {_cut('code')} as code, {_cut('strings')} as z, {_cut('comments')} as c, {_cut('opens')} as o from cut),
views as (select diff_id, file_idx, added_idx, n, raw, code, {_stripped('z')} as strings_view, case when z = '' then cast([] as varchar[]) else string_split({_stripped('z')}, chr(1)) end as string_list,
        replace({_stripped('c')}, chr(1), ' ') as comment, contains(o, 'U') as in_string from split)"""


def _fires(rule: dict) -> str:
    col = {"raw": "raw", "code": "code", "string": "strings_view", "comment": "comment"}[rule["view"]]
    if rule["id"] == "long-line":
        cond = f"{units('raw')} >= 500 and not regexp_matches(raw, '[\\n\\r\\x{{2028}}\\x{{2029}}]')"
    elif rule["id"] == "insecure-deserialize":  # no lookahead in this dialect: what stands before the closing bracket is looked at
        plain, lookahead = [], []
        for part in rule["pattern"].split("|"):
            (lookahead if "(?!" in part else plain).append(part)
        call = lookahead[0].split("(?!")[0]
        calls = f"regexp_extract_all(code, {literal(translate(call, java=False) + '([^)]*)')}, 1)"
        cond = f"(regexp_matches(code, {literal(translate('|'.join(plain), java=False))}) or len(list_filter({calls}, lambda x: not contains(x, 'Loader'))) > 0)"
    elif rule["id"] == "hardcoded-ip":  # likewise: separators are doubled, so that neighbours don't share one, and addresses filtered
        apart = "regexp_replace(raw, '([^.0-9])', '\\1\\1', 'g')"
        found = f"regexp_extract_all({apart}, '(?:^|[^.0-9])([1-9][0-9]{{0,2}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}})(?:[^.0-9]|\\z)', 1)"
        cond = f"len(list_filter({found}, lambda x: not regexp_matches(x, '^(?:(?:10|127|192\\.168|169\\.254)\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.)'))) > 0"
    else:
        cond = f"regexp_matches({col}, {literal(translate(rule['pattern'], rule['ignore_case'], java=False))})"
    files = f"{rule['files']} and " if rule["files"] else ""
    return f"{files}{col} <> '' and {cond}"


_HEAD = "diff_id, '{0}' as rule_id, {1} as seq, file_idx"
_one = lambda rule_id: _HEAD.format(rule_id, SEQUENCE.index(rule_id))
#: Rules of lines, as a flag each in one pass over the views.
_LINES = " union all ".join(f"select {_one(r['id'])}, added_idx, path, n as line, raw, null as detail from fired where f{k}" for k, r in enumerate(LINE_RULES))
FILE_RULES = {
    "test-deleted": "status = 'deleted' and is_test", "secret-file": "status <> 'deleted' and is_secret_file", "dep-change": "status <> 'deleted' and is_manifest and not is_lockfile", "migration": "status <> 'deleted' and is_migration",
    "infra-change": "status <> 'deleted' and is_infra", "large-file-churn": "churn >= 400", "binary-added": "is_binary and status <> 'deleted'", "lockfile-only-note": "status <> 'deleted' and is_lockfile",
}
_snippet = lambda k: "coalesce(path, 'null') || ' (' || churn || ' lines)'" if k == "large-file-churn" else "path"
_FILES = " union all ".join(f"select {_one(k)}, 0 as added_idx, path, cast(0 as bigint) as line, {_snippet(k)} as snippet, null as detail from flagged where {v}" for k, v in FILE_RULES.items())
_benign = " and ".join(f"not regexp_matches(s, {literal(p)})" for p in entropy.BENIGN if "\\1" not in p)
_points = lambda cond, v: f"case when {cond} then {v} else 0 end"
HITS = VIEWS + f""",
scanned as (select v.*, f.path, f.is_code, f.is_test, f.js_like from views v join flagged f using (diff_id, file_idx) where not f.is_binary and f.status <> 'deleted'),
fired as (select diff_id, file_idx, added_idx, path, n, raw, {", ".join(f"coalesce({_fires(r)}, false) as f{k}" for k, r in enumerate(LINE_RULES))} from scanned),
line_hit as (select diff_id, rule_id, seq, file_idx, added_idx, path, line, {shown(trim('raw'))} as snippet, detail from ({_LINES})),
file_hit as ({_FILES}),
candidate as (select diff_id, file_idx, added_idx, unnest(c) as c, unnest(generate_series(0, len(c) - 1)) as place from (
        select diff_id, file_idx, added_idx, flatten(list_transform(string_list, lambda s: list_concat([s], regexp_extract_all(s, '({entropy.RUN})', 1)))) as c from scanned where length(strings_view) >= 20)),
shaped as (select *, string_split(s, '') as chars from (select *, {trim('c')} as s from candidate) where length(s) between 20 and 200 and regexp_matches(s, '^[A-Za-z0-9+/_\\-]+={{0,2}}\\z') and {_benign}),
spread as (select *, len(list_distinct(chars)) as kinds from shaped where len(list_distinct(chars)) > 1),
measured as (select *, list_sum(list_transform(list_distinct(chars), lambda ch: -(len(list_filter(chars, lambda y: y = ch)) / length(s)) * log2(len(list_filter(chars, lambda y: y = ch)) / length(s)))) as h,
        {" + ".join(f"cast(regexp_matches(s, '{p}') as integer)" for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))} as classes,
        regexp_matches(s, '(?i)^[0-9a-f]+\\z') and length(s) in ({", ".join(map(str, entropy.HASH_LENGTHS))}) as hashed from spread where kinds / length(s) >= 0.35),
rated as (select *, least(95, 40 + {_points("h >= 4.3", 20)} + {_points("h >= 4.6", 10)} + {_points("length(s) >= 32", 15)} + {_points("classes >= 3", 15)}) as sure, floor(h * 100 + 0.5) / 100 as e from measured where h >= case when hashed then 3.6 else 4.0 end and classes >= 2),
best as (select * from (select *, row_number() over (partition by diff_id, file_idx, added_idx order by sure desc, place) as nth from rated) where nth = 1),
entropy_hit as (select {_one('entropy-secret')}, added_idx, path, n as line, {shown(trim('raw'))} as snippet, 'entropy ' || {number('e')} || ' bits/char' as detail from best join scanned using (diff_id, file_idx, added_idx)),
verdict as (select diff_id, coalesce(sum(additions) filter (is_code and not is_test), 0) >= 30 and not bool_or(is_test and status <> 'deleted') as fires from flagged group by diff_id),
touched as (select {_one('logic-without-tests')}, 0 as added_idx, path, cast(0 as bigint) as line, path as snippet, null as detail from flagged where is_code and not is_test and churn > 0),
told as (select diff_id, file_idx, n, lower(regexp_extract(comment, {literal(directive_pattern(java=False))}, 1)) as kind, regexp_split_to_array(regexp_extract(comment, {literal(directive_pattern(java=False))}, 2), '[{WS},]+') as names
        from views where contains(comment, '{DEFAULT_PREFIX}') and regexp_matches(comment, {literal(directive_pattern(java=False))})),
directive as (select diff_id, path, case when kind = '-file' then null when starts_with(kind, '-next') then n + 1 else n end as line, unnest(case when len(names) = 0 then cast([null] as varchar[]) else names end) as rule_id
        from (select diff_id, path, kind, n, list_filter(names, lambda x: x <> '' and x <> '{DEFAULT_PREFIX.rstrip("-")}') as names from told join file using (diff_id, file_idx))),
found as (select * from line_hit union all select * from file_hit union all select * from entropy_hit union all select * from touched),
marked as (select f.*, exists (select 1 from directive d where d.diff_id = f.diff_id and {same('d.path', 'f.path')} and (d.line is null or d.line = f.line) and (d.rule_id is null or d.rule_id = f.rule_id)) as suppressed from found f),
first_entropy as (select * exclude (nth) from (select *, row_number() over (partition by diff_id, path, line order by file_idx, added_idx) as nth from marked where rule_id = 'entropy-secret') where suppressed or nth = 1),
capped as (select * exclude (before) from (select *, coalesce(sum(cast(not suppressed as integer)) over (partition by diff_id, rule_id order by file_idx, added_idx rows between unbounded preceding and 1 preceding), 0) as before
        from (select * from marked where rule_id not in ('entropy-secret', 'logic-without-tests') union all select * from first_entropy)) where before < case rule_id {" ".join(f"when '{k}' then {v}" for k, v in CAPS.items())} else 1000000000 end),
untested as (select * exclude (nth, fires) from (select m.*, v.fires, row_number() over (partition by m.diff_id, m.suppressed order by file_idx) as nth from marked m join verdict v using (diff_id) where rule_id = 'logic-without-tests') where suppressed or fires and nth <= 8),
seen as (select * from capped union all select * from untested),
hit as (select * exclude (suppressed) from seen where not suppressed)"""

_rules = ", ".join(f"({literal(r['id'])}, {literal(r['title'])}, {literal(r['category'])}, {literal(r['severity'])}, {list(WEIGHTS).index(r['severity'])}, {WEIGHTS[r['severity']]}, {float(r['confidence'])}, {', '.join('null' if r[c] is None else literal(r[c]) for c in ('cwe', 'owasp', 'why', 'fix'))})" for r in RULES)
CATALOG = ", ".join(f"({literal(r['id'])}, {literal(r['title'])}, {literal(r['category'])}, {literal(r['severity'])}, {SEQUENCE.index(r['id'])})" for r in RULES)
WORST = list(reversed(WEIGHTS))
_indent = "length(replace(regexp_extract(raw, '^[\\t ]*'), chr(9), '    '))"
_decisions = lambda x: f"len(regexp_extract_all({x}, {literal(translate(DECISION_WORDS, java=False))}))"
METRICS = HITS + f""",
rule as (select * from (values {_rules}) as t(rule_id, title, category, severity, sev_rank, weight, confidence, cwe, owasp, why, fix)),
signal as (select diff_id, rule_id, title, category, severity, sev_rank, weight, confidence, cwe, owasp, why, fix, seq, cast(count(*) as bigint) as n_hits from hit join rule using (rule_id) group by all),
ordered as (select *, row_number() over (partition by diff_id order by sev_rank desc, n_hits desc, seq) as ord from signal),
total as (select diff_id, cast(count(*) as bigint) as files, cast(sum(additions) as bigint) as additions, cast(sum(deletions) as bigint) as deletions, cast(sum(churn) as bigint) as churn,
        cast(sum(cast(is_test as integer)) as bigint) as test_files, cast(sum(cast(is_code and not is_test as integer)) as bigint) as code_files from flagged group by diff_id),
sorted_lines as (select *, {trim('code')} = '' as blank, {trim('comment')} <> '' as says, {_indent} as indent from views),
added as (select diff_id, cast(sum({_decisions('code')}) as bigint) as decisions_added, cast(sum(cast(blank and says as integer)) as bigint) as comment_lines, cast(sum(cast(not blank as integer)) as bigint) as code_lines,
        max(indent) filter (not blank) as widest, min(indent) filter (not blank) as least from sorted_lines group by diff_id),
removed as (select diff_id, cast(sum({_decisions('text')}) as bigint) as decisions_removed from line where type = 'del' group by diff_id),
change as (select t.diff_id, files, additions, deletions, churn, coalesce(decisions_added, 0) as decisions_added, coalesce(decisions_removed, 0) as decisions_removed, coalesce(comment_lines, 0) as comment_lines,
        coalesce(code_lines, 0) as code_lines, widest, least, test_files, code_files from total t left join added using (diff_id) left join removed using (diff_id)),
metrics as (select diff_id, files, additions, deletions, churn, decisions_added - decisions_removed as complexity_delta, decisions_added, decisions_removed,
        coalesce(greatest(0, {half("(greatest(0, widest) - least) / 4")}), 0) as max_nesting_added, case when comment_lines + code_lines > 0 then floor(comment_lines / (comment_lines + code_lines) * 100 + 0.5) / 100 else 0.0 end as comment_ratio,
        comment_lines, code_lines, test_files, code_files, greatest(2, {half("churn / 8 + files * 1.5 + greatest(0, decisions_added - decisions_removed) * 0.6")}) as review_minutes from change)"""

_by_severity = ", ".join(f"cast(sum(cast(pts as decimal(24,9))) filter (severity = '{s}') as double) as p_{s}, count(*) filter (severity = '{s}') as n_{s}" for s in WEIGHTS)
_steps = " union all ".join(
    [f"select diff_id, {k} as o, '{s.capitalize()} signals' as label, n_{s} || case when n_{s} > 1 then ' rules' else ' rule' end as detail, {tenth(f'p_{s}')} as points from scored where n_{s} > 0" for k, s in enumerate(WORST)]
    + [f"select diff_id, {k}, '{label}', {detail}, {tenth(c)} from scored where {c} > 0.05" for k, label, detail, c in (
        (5, "Change size", "churn || ' lines changed'", "churn_pts"), (6, "Files touched", "files || ' files'", "file_pts"), (7, "Added complexity", "'+' || complexity_delta || ' decision points'", "cplx_pts"))]
    + [f"select diff_id, 8, 'Squash to 0–100', 'raw ' || {number(tenth('points'))} || ' pts → ' || {half('raw')} || case when crit then ' → Critical-severity floor' when floor_high then ' → High-severity floor' else '' end, null from scored"]
)
_many = lambda n, what: f"' ' || {n} || ' {what}' || case when {n} > 1 then 's' else '' end || ' found.'"
SCORES = METRICS + f""",
weighed as (select diff_id, severity, sev_rank, weight * (0.55 + 0.45 * confidence) * (1 + 0.5 * (least(n_hits, 12) - 1)) as pts from signal),
sums as (select diff_id, {_by_severity}, max(sev_rank) as worst from weighed group by diff_id),
parts as (select m.*, {", ".join(f"coalesce(p_{s}, 0.0) as p_{s}, coalesce(n_{s}, 0) as n_{s}" for s in WEIGHTS)}, least(28.0, log2(churn + 1) * 3) as churn_pts, least(12.0, files * 1.5) as file_pts,
        case when complexity_delta > 0 then least(10.0, complexity_delta * 0.8) else 0.0 end as cplx_pts from metrics m left join sums using (diff_id)),
pointed as (select *, {" + ".join(f"p_{s}" for s in WORST)} + {" + ".join(f"case when {c} > 0.05 then {c} else 0.0 end" for c in ("churn_pts", "file_pts", "cplx_pts"))} as points from parts),
squashed as (select *, 100 * (1 - exp(-points / 55)) as raw from pointed),
scored as (select *, n_critical > 0 and raw < 82 as crit, n_critical = 0 and n_high > 0 and raw < 60 as floor_high from squashed),
hidden as (select diff_id, cast(count(*) as bigint) as suppressed from seen where suppressed group by diff_id),
rated_change as (select s.*, cast(greatest(0, least(100, floor(case when crit then 82 when floor_high then 60 else raw end + 0.5))) as integer) as score, coalesce(h.suppressed, 0) as suppressed from scored s left join hidden h using (diff_id)),
score as (select *, case when score < 25 then 'Low' when score < 55 then 'Moderate' when score < 80 then 'High' else 'Critical' end as tier, case when score < 25 then 'safe' when score < 55 then 'notice' when score < 80 then 'warn' else 'danger' end as color,
        case when score < 25 then 'Low-risk change.' when score < 55 then 'Reviewable, with a few things to check.' when score < 80 then 'Needs a careful review.' else 'Do not merge as-is.' end || ' ' || files || case when files = 1 then ' file' else ' files' end
        || ' changed · +' || additions || ' / −' || deletions || ' · ~' || review_minutes || ' min review.' || case when n_critical > 0 then {_many('n_critical', 'critical issue')} when n_high > 0 then {_many('n_high', 'high-severity issue')} else '' end as summary from rated_change),
step as (select diff_id, cast(row_number() over (partition by diff_id order by o) - 1 as integer) as step_no, label, detail, points from ({_steps})),
flag as (select diff_id, path, line, rule_id, severity from (select h.diff_id, h.path, h.line, h.rule_id, o.severity, row_number() over (partition by h.diff_id, h.path, h.line order by o.sev_rank desc, o.ord) as nth
        from hit h join ordered o using (diff_id, rule_id) where h.line <> 0) where nth = 1)"""


def _needed(needs: str | list[str]) -> str:
    if isinstance(needs, str):
        return f"exists (select 1 from signal s where s.diff_id = m.diff_id and s.category = '{needs}')"
    return f"exists (select 1 from signal s where s.diff_id = m.diff_id and s.rule_id in ({', '.join(map(literal, needs))}))"


_items = [f"select diff_id, {k} as o, '{pri}' as pri, {literal(text)} as text from metrics m where {_needed(needs)}" for k, (pri, text, needs) in enumerate(score.CHECKLIST)]
_items.append("select diff_id, 90, 'nice', 'Deeply nested code was added (depth ~' || max_nesting_added || ') — consider flattening for readability.' from metrics where max_nesting_added >= 4")
_items += [f"select diff_id, {91 + k}, 'always', {literal(t)} from metrics" for k, t in enumerate(score.ALWAYS)] + [f"select diff_id, 99, 'always', {literal(score.ONCE_MORE)} from metrics where churn > 0"]
CHECKS = SCORES + f""",
checks as (select diff_id, cast(row_number() over (partition by diff_id order by o) - 1 as integer) as ord, pri, text from ({" union all ".join(_items)}))"""

_line_no = "case when line <> 0 then ':' || line else '' end"
_counts = " union all ".join(f"select diff_id, {k} as o, '| {s.capitalize()} | ' || sum(n_hits) || ' |' as row_ from signal where severity = '{s}' group by diff_id" for k, s in enumerate(WORST))


def _told(alias: str, name: str, order: str, source: str) -> str:
    return f"{alias} as (select diff_id, string_agg({name}, chr(10) order by {order}) as {alias} from {source} group by diff_id)"


def markdown(tool: str) -> str:
    return CHECKS + f""",
place as (select *, row_number() over (partition by diff_id, rule_id order by file_idx, added_idx, path, line) as nth from hit),
placed as (select diff_id, rule_id, string_agg('- `' || coalesce(path, '?') || {_line_no} || '`' || case when line <> 0 and snippet <> '' then ' — `' || snippet || '`' else '' end, chr(10) order by nth) as places from place where nth <= 8 group by diff_id, rule_id),
told_signal as (select diff_id, ord, chr(10) || '### [' || upper(severity) || '] ' || title || ' (' || n_hits || '×)' || chr(10) || '_' || category || coalesce(' · ' || nullif(concat_ws(' · ', cwe, owasp), ''), '') || ' · confidence '
        || {half("confidence * 100")} || '%_' || chr(10) || chr(10) || why || chr(10) || '**Fix:** ' || fix || chr(10) || places as t from ordered join placed using (diff_id, rule_id)),
{_told("body", "t", "ord", "told_signal")}, {_told("counted", "row_", "o", f"({_counts})")}, {_told("todo", "'- [ ] **' || pri || '** — ' || text", "ord", "checks")}
select diff_id, concat_ws(chr(10), '# {tool} risk report', '', '**Risk score:** ' || score || '/100 — **' || tier || ' risk**', '', '> ' || summary, '', '| Severity | Count |' || chr(10) || '|---|---|' || chr(10) || counted || chr(10),
        '**Change:** ' || files || ' files · +' || additions || ' / −' || deletions || ' · complexity Δ ' || case when complexity_delta >= 0 then '+' else '' end || complexity_delta || ' · ~' || review_minutes || ' min review', '', '## Signals',
        coalesce(body, '_No risk signals fired._'), '', '## Review checklist', todo, '', '_Generated locally by {tool}. Heuristic radar, not a proof of safety._') as report
from score left join body using (diff_id) left join counted using (diff_id) left join todo using (diff_id)"""


def text(tool: str) -> str:
    return CHECKS + f""",
place as (select *, row_number() over (partition by diff_id, rule_id order by file_idx, added_idx, path, line) as nth from hit),
told_signal as (select diff_id, ord, '  ● ' || lpad(upper(severity), 8, ' ') || ' ' || case when length(title) > 34 then title[1:33] || '…' else rpad(title, 34, ' ') end || ' ' || coalesce(cwe, '')
        || case when n_hits > 1 then '  ×' || n_hits else '' end || chr(10) || '      ' || coalesce(path, 'null') || {_line_no} as t from ordered join place using (diff_id, rule_id) where nth = 1),
{_told("body", "t", "ord", "(select * from told_signal where ord <= 24)")}, n_told as (select diff_id, count(*) as n from told_signal group by diff_id)
select diff_id, concat_ws(chr(10), '', '{tool} — risk report', '', '  Score ' || lpad(cast(score as varchar), 3, ' ') || ' / 100  ' || upper(tier),
        '  Change ' || files || case when files = 1 then ' file' else ' files' end || ' · +' || additions || ' / −' || deletions || ' · ~' || review_minutes || ' min review', '  ' || summary, '',
        coalesce('Signals (' || n || ')' || chr(10) || body, '  No risk signals found.'), case when n > 24 then '  … +' || (n - 24) || ' more' end,
        case when suppressed > 0 then chr(10) || '  ' || suppressed || ' signal' || case when suppressed > 1 then 's' else '' end || ' suppressed by inline directives' end, '') as report
from score left join body using (diff_id) left join n_told using (diff_id)"""
