"""SQL for an independent engine: the expected result of every query on the same tables.

The SQL starts from the scalar formulas of the inputs and computes results relationally. It never
sees the JSON reports the Spark side parses, nor any Spark code.
"""

from __future__ import annotations

from lintharbor.functions.severity import STRIP_CHARS
from lintharbor.operators.policy import SCANNERS
from lintharbor.rules import CODE_RULES, CONTROL_RULES, OWASP_CATEGORIES, REMEDIES, SECRET_RULES
from lintharbor.sinks.sarif import SCHEMA_URI
from lintharbor.workload import fixtures as fx

CHUNK = 256


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = "'" + STRIP_CHARS.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def norm(x: str) -> str:
    s = strip(f"lower({x})")
    return (f"case when {s} in ('moderate','warning','warn') then 'medium' when {s} = 'error' then 'high' "
            f"when {s} in ('info','informational') then 'low' else {s} end")


BUCKET = ("case when severity = 'critical' then 'critical' when severity = 'high' then 'high' "
          "when severity in ('medium','moderate') then 'medium' else 'low' end")
RANK = "case bucket when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end"


def cols(fields: dict[str, str], skip: tuple[str, ...] = ()) -> str:
    return ", ".join(f'{e} as "{n}"' for n, e in fields.items() if n not in skip)


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def fnd(scan: str = fx.HALF) -> list[str]:
    """raw -> f (normalised) with bucket and fingerprint."""
    return [
        f"raw as (select {cols(fx.RAW)}, {scan} as scan_id from events)",
        f"f0 as (select *, {norm(NULLIF_SEV)} as severity from raw)",
        f"f1 as (select *, {BUCKET} as bucket, concat(coalesce(file,''), ':', cast(coalesce(line,0) as varchar), "
        "':', coalesce(tool,''), ':', coalesce(rule_id, title, '')) as fp from f0)",
        f"f as (select *, {RANK} as rnk from f1)",
    ]


NULLIF_SEV = "coalesce(nullif(severity_raw, ''), 'medium')"
DED = ("d as (select * exclude (n_) from (select *, row_number() over (partition by project, scan_id, fp "
       "order by seq) as n_ from f) where n_ = 1)")
COUNTS = (
    "c as (select project, scan_id, count(*) filter (bucket='critical') as critical_count, "
    "count(*) filter (bucket='high') as high_count, count(*) filter (bucket='medium') as medium_count, "
    "count(*) filter (bucket='low') as low_count, count(*) as total from d group by all)")
PRE = (
    "p as (select project, scan_id, count(*) filter (tool='Secret Scanner') as secrets_found, "
    "count(*) filter (tool in ('pip-audit','npm audit')) as outdated_dependencies from f group by all)")
SCORES = (
    "s as (select *, least(raw_risk_score, 100) as risk_score, "
    "least(critical_count*25 + high_count*10 + medium_count*3 + low_count, 100) as linear_score from ("
    "select *, cast(floor(case when critical_count > 0 then 50 + least(30.0, 10*log2(critical_count+1)) "
    "else 0.0 end + least(40.0, 15*log2(high_count+1)) + least(20.0, 7*log2(medium_count+1)) "
    "+ least(10.0, 3*log2(low_count+1))) as bigint) as raw_risk_score from c))")
LEVEL = ("case when risk_score >= 75 then 'CRITICAL' when risk_score >= 50 then 'HIGH' "
         "when risk_score >= 25 then 'MEDIUM' else 'LOW' end")
HOURLY = [*fnd(fx.HOUR), DED, COUNTS, SCORES]
HALVES = [*fnd(), DED, COUNTS]

RUNS = f"r as (select {cols(fx.RUN)}, * exclude (ts) from events)"


def items(fields: dict[str, str], n: int, name: str = "x", extra: str = "") -> str:
    """Report items of tool number n: readable reports only."""
    more = f", {extra}" if extra else ""
    return (f"{name} as (select project, scan_id, run_no, exit_code, i as pos, unit, event_id, {cols(fields)}"
            f"{more} from (select *, unnest(range(event_id % 4)) as i from r where kind = 'report' "
            f"and event_id % 6 = {n}))")


def as_joined(raw: str, sep: str = ", ") -> str:
    """Joined text of a field written as a JSON list or scalar (plain texts without commas inside)."""
    body = (f"replace(replace(trim({raw}, '[]'), '\",\"', '{sep}'), '\"', '')")
    return f"coalesce({body}, '')"


SEM = {
    **{k: v for k, v in fx.SEMGREP.items() if k not in ("check_id", "path", "message", "severity")},
    "check": fx.SEMGREP["check_id"], "path": fx.SEMGREP["path"], "msg": fx.SEMGREP["message"],
    "sev_raw": fx.SEMGREP["severity"], "end_line": f"cast({fx.V} % 10 + 1 as int)",
    "tk": f"{fx.K} % 8",
}
TAX = (
    "case when cwe_txt <> '' then concat(' (CWE: ', cwe_txt, ')') else '' end || "
    "case when owasp_txt <> '' then concat(' [OWASP: ', owasp_txt, ']') else '' end")
SEMGREP = [
    RUNS, items(SEM, 5, "x0"),
    f"x1 as (select *, {as_joined('cwe')} as cwe_txt, {as_joined('owasp')} as owasp_txt, "
    f"{as_joined('refs')} as refs_txt, {as_joined('technology', '|')} as tech_txt, "
    "case upper(coalesce(sev_raw,'WARNING')) when 'ERROR' then 'high' when 'INFO' then 'low' "
    "when 'INVENTORY' then 'low' when 'EXPERIMENT' then 'low' else 'medium' end as severity, "
    "tk in (1,2,5,6,7) as taint, tk in (1,2,5) as has_src, tk in (2,6) as has_sink from x0)",
    f"x2 as (select *, {TAX} as tax, coalesce(check_id_, 'unknown') as rule_id, "
    "coalesce(path, 'unknown') as file, "
    "coalesce(short, check_id_, 'Security Issue') as title from "
    '(select *, "check" as check_id_ from x1))',
    "x as (select *, case when taint then '[TAINT ANALYSIS] ' || case when has_src then 'Source: in.py:3 -> ' "
    "else '' end || case when has_sink then 'Sink: out.py:0' else '' end || ' ' else '' end as prefix from x2)",
]
BANDIT = [
    RUNS, items(fx.BANDIT, 0, "x0"),
    f"x as (select *, {norm(chr(0))} as sev from x0)".replace(
        chr(0), "coalesce(nullif(severity,''), nullif(issue_severity,''), 'medium')"),
]
PIP = [
    RUNS, items({"name": fx.PIP["name"], "version": fx.PIP["version"], "n_vulns": fx.PIP_VULNS,
                 "event_type": "event_type", "i": "i"}, 3, "dep"),
    "v0 as (select *, unnest(range(cast(n_vulns as bigint))) as j from dep)",
    f"v1 as (select * exclude (pos), {fx.PIP_VULN['id']} as vid, {fx.PIP_VULN['description']} as descr, "
    f"{fx.PIP_VULN['alias']} as alias, cast(row_number() over (partition by run_no order by i, j) - 1 as int) "
    "as pos from v0)",
    "x as (select *, case when contains(upper(vid), 'CRITICAL') then 'critical' when contains(alias, 'GHSA') "
    "then 'high' else 'medium' end as severity, coalesce(descr, 'Vulnerability ' || vid) as description, "
    "case when j = 0 then '1.2, 2.0' else '' end as fixes from v1)",
]
NPM = [RUNS, items(fx.NPM, 2, "x0"),
       "x as (select project, scan_id, run_no, exit_code, pos, package, coalesce(severity,'unknown') as severity, "
       "coalesce(via,'[]') as via, coalesce(range,'unknown') as version_range, "
       "coalesce(fixAvailable,'false') as fix_available from x0)"]
ESLINT = [RUNS, items({**fx.ESLINT, "file": fx.ESLINT_FILE}, 1, "x0"),
          "x as (select project, scan_id, run_no, exit_code, cast(pos as int) as message_no, file, "
          "coalesce(line,0) as line, coalesce(\"column\",0) as \"column\", "
          "case coalesce(severity,1) when 2 then 'high' when 1 then 'medium' else 'low' end as severity, "
          "message, coalesce(\"ruleId\",'') as rule_id from x0)"]
SECRETS = [RUNS, items(fx.SECRET, 4, "x")]
SEQ = "run_no * 4294967296 + pos"
OK = "exit_code in (0, 1)"
RK = "project, scan_id, run_no"

# All tools' findings from reports, with the run's exit code.
ALL = [
    RUNS,
    *[c for c in BANDIT[1:-1]], BANDIT[-1].replace("x as (", "b as (", 1),
    ESLINT[1].replace("x0 as", "e0 as", 1), ESLINT[2].replace("x as (", "e as (", 1).replace("from x0", "from e0"),
    NPM[1].replace("x0 as", "n0 as", 1), NPM[2].replace("x as (", "n as (", 1).replace("from x0", "from n0"),
    *PIP[1:-1], PIP[-1].replace("x as (", "pp as (", 1),
    SECRETS[1].replace("x as (", "sc as (", 1),
    SEMGREP[1].replace("x0 as", "g0 as", 1), SEMGREP[2].replace("from x0", "from g0"), *SEMGREP[3:-1],
    SEMGREP[-1].replace("x as (", "g as (", 1),
    f"""u as (
 select project, scan_id, {SEQ} as seq, exit_code, 'Bandit' as tool, sev as severity,
  case when title is not null then title else coalesce(test_name, 'Security Issue') end as title,
  coalesce(filename,'unknown') as file, line_number as line, coalesce(test_id,'') as rule_id, false as r_null from b
 union all select project, scan_id, run_no * 4294967296 + message_no, exit_code, 'ESLint', severity, rule_id, file,
  line, rule_id, false from e where contains(rule_id, 'security/')
 union all select project, scan_id, {SEQ}, exit_code, 'npm audit', {norm('severity')}, 'Vulnerable package: ' || package,
  'package.json', 0, null, true from n
 union all select project, scan_id, {SEQ}, exit_code, 'pip-audit', severity, 'Vulnerable package: ' || name,
  unit, 0, vid, false from pp
 union all select project, scan_id, {SEQ}, exit_code, 'Secret Scanner', {norm("coalesce(severity,'high')")},
  'Exposed secret: ' || coalesce("type", 'Unknown'), file, line, null, true from sc
 union all select project, scan_id, {SEQ}, exit_code, 'Semgrep', severity, title, file, line, rule_id, false from g)""",
]

FILES = [
    f"fl0 as (select *, {cols(fx.FILE)}, {fx.REL_PATH} as rel_path, {fx.APP} as app from part)",
    "fl1 as (select *, regexp_extract(rel_path, '\\.([a-z]+)$', 1) as ext, "
    "rel_path like '%package.json' as is_pkg, "
    "(rel_path like 'node_modules/%' or rel_path like 'build/%' or rel_path like '.git/%' "
    "or rel_path like 'venv/%') as excluded_dir from fl0)",
    "fl as (select *, case when is_pkg then 'package_json' when ext = 'py' then 'python' "
    "when ext in ('js','jsx') then 'javascript' when ext in ('ts','tsx') then 'typescript' end as language from fl1)",
    "inc as (select * from fl where not excluded_dir and language is not null)",
    "lang as (select project, count(*) filter (language='python') as python_files, "
    "count(*) filter (language='javascript') as js_files, count(*) filter (language='typescript') as ts_files, "
    "count(*) filter (language='package_json') as package_json_files from inc group by project)",
]


def snippet_hits() -> str:
    """Expected (path, line, rule) of the snippet corpus."""
    rows = []
    meta = {r.rule_id: r for r in CODE_RULES}
    for no, (_, hits) in enumerate(fx.SNIPPETS):
        for line, group, rule in hits:
            r = meta[rule]
            rows.append(f"({no}, {line}, '{group}', '{rule}', {lit(r.title)}, '{r.owasp}', {lit(r.family)}, "
                        f"'{r.severity}')")
    return (
        "hits as (select fl.project, fl.path, fl.language, fl.app, "
        f"cast(h.off + {fx.FILLER_LINES} as int) as line, h.rule_id, h.title, h.owasp, h.family, h.severity from fl "
        f"join (values {', '.join(rows)}) h(no, off, grp, rule_id, title, owasp, family, severity) "
        f"on h.no = {fx.SNIPPET_NO} and ((h.grp = 'py' and language = 'python') or "
        "(h.grp = 'js' and language in ('javascript','typescript'))))")


def control_hits() -> str:
    rows = []
    meta = {r.rule_id: r for r in CONTROL_RULES}
    for no, (_, _, group, bare, guarded) in enumerate(fx.CONTROLS):
        for flag, found in (("false", bare), ("true", guarded)):
            rows += [f"({no}, {flag}, '{group}', '{x}', {lit(meta[x].title)}, '{meta[x].owasp}')" for x in found]
    return (
        f"select fl.project, fl.path, h.rule_id, h.title, h.owasp from fl join (values {', '.join(rows)}) "
        f"h(no, guarded, grp, rule_id, title, owasp) on h.no = {fx.CONTROL_NO} and h.guarded = ({fx.GUARDED}) "
        "and ((h.grp in ('py', 'any') and language = 'python') or "
        "(h.grp in ('js', 'any') and language in ('javascript','typescript')))")


CORPUS = [
    "corpus as (select source as project, 'documents/' || doc_id as path, text from documents "
    "union all select 'pages', 'pages/' || page_id, html from pages "
    "union all select 'conversations', 'conversations/' || conv_id || '/' || turn, text from conversations)",
    "lines as (select project, path, unnest(string_split(text, chr(10))) as content, "
    "generate_subscripts(string_split(text, chr(10)), 1) as line from corpus)",
]


def secret_hits() -> list[str]:
    """Every rule tried at every character of a line, then a sweep that takes the first match behind the last one taken."""
    any_rule = "|".join(f"(?:{r.pattern})" for r in SECRET_RULES)

    def tried(rank: int, r) -> str:
        core = f"^({r.core})" + (f"(?:$|[^{r.not_after}])" if r.not_after else "")
        before = " and (s = 0 or not regexp_matches(content[s], '[A-Za-z0-9_]'))" if r.whole_word else ""
        return (f"select u, project, path, line, s, s + length(regexp_extract(rest, {lit(core)}, 1)) as e, {rank} as rank, "
                f"{str(r.generic).lower()} as generic from places where regexp_matches(rest, {lit(core)}){before}")

    def sweep(name: str, source: str) -> str:
        best = f"min(row(c.s, -c.e, c.rank)) as m from {source} c"
        return (f"{name} as (select u, {best} group by u union all "
                f"select c.u, {best} join {name} t on c.u = t.u and c.s >= -(t.m[2]) group by c.u)")

    rules = ", ".join(f"({i}, '{r.rule_id}', {lit(r.title)}, '{r.severity}')" for i, r in enumerate(SECRET_RULES))
    return [*CORPUS,
            "hit as (select *, row_number() over () as u from lines where "
            f"regexp_matches(content, {lit(any_rule)}))",
            "places as (select * exclude (i), i - 1 as s, content[i:] as rest from hit, range(1, length(content) + 1) r(i))",
            "cand as (" + " union all ".join(tried(i, r) for i, r in enumerate(SECRET_RULES)) + ")",
            "special as (select * from cand where not generic)",
            sweep("sure", "special"),
            "other as (select c.* from cand c where generic and not exists (select 1 from sure t where t.u = c.u "
            "and c.s < -(t.m[2]) and t.m[1] < c.e))",
            sweep("rest", "other"),
            "taken as (select * from sure union all select * from rest)",
            "sec as (select project, path, cast(line as int) as line, cast(m[1] + 1 as int) as \"column\", "
            "cast(row_number() over (partition by u order by m[1]) as int) as nth, rule_id, title, severity from taken join hit using (u) "
            f"join (values {rules}) k(rank, rule_id, title, severity) on k.rank = m[3])"]


EXPECTED_POLICY = {
    # c_custkey % 8 -> leaves that differ from the defaults
    2: {"python": "false"}, 3: {"formats": "'html'", "fail_on": "'low'"},
    4: {"secrets": "false", "exclude": "'**/gen/**|*.min.js'"},
    5: {"minimum": "'high'", "fail_on": "'CRITICAL'", "verbose": "true", "json_file": "'out.json'"},
    6: {"javascript": "false"}, 7: {"fail_on": "'medium'", "include": "'src/*'"},
}
DEFAULT_POLICY = {
    **{s: "true" for s in SCANNERS}, "exclude": "''", "include": "''", "formats": "'text|json|html|sarif'",
    "json_file": "'security-results.json'", "html_file": "'security-report.html'",
    "sarif_file": "'security-results.sarif'", "verbose": "false", "minimum": "'low'", "fail_on": "'high'",
}


def policy_sql() -> str:
    out = []
    for name, default in DEFAULT_POLICY.items():
        cases = " ".join(f"when {k} then {v[name]}" for k, v in EXPECTED_POLICY.items() if name in v)
        expr = f"case c_custkey % 8 {cases} else {default} end" if cases else default
        if name == "formats":
            expr = f"case when c_custkey % 11 = 0 then 'html|json' else {expr} end"
        if name == "dependencies":
            expr = "c_custkey % 3 <> 1"
        out.append(f"{expr} as {name}")
    return f"select {fx.CLIENT} as project, {', '.join(out)} from customer"


SETTINGS = (f"st as (select distinct {fx.PROJECT} as project, {cols(fx.SETTINGS)} from events "
            f"where {fx.NUM} < 8)")

RUN_RANK = (
    "case tool when 'Bandit' then 1 when 'ESLint' then 2 when 'npm audit' then 2 when 'Secret Scanner' then 3 "
    "when 'Semgrep' then 4 when 'pip-audit' then 5 end")
RUN_NAMES = {1: "Bandit", 2: "ESLint Security", 3: "Secret Scanner", 4: "Semgrep", 5: "pip-audit"}
RUN_NAME = "case run_rank " + " ".join(f"when {k} then '{v}'" for k, v in RUN_NAMES.items()) + " end"
SARIF_LEVEL = ("case when severity in ('critical','high') then 'error' when severity = 'medium' then 'warning' "
               "else 'note' end")
SARIF_SCORE = ("case severity when 'critical' then '9.5' when 'high' then '7.5' when 'low' then '2.5' "
               "when 'info' then '0.0' else '5.0' end")


def sarif_rows(source: str) -> list[str]:
    return [
        f"q0 as (select *, {RUN_RANK} as run_rank from {source})",
        f"q as (select *, {RUN_NAME} as run_name, coalesce(rule_id, 'UNKNOWN') as rule_key, {SARIF_LEVEL} as level, "
        "case when starts_with(file, '/srv/' || project || '/') then substr(file, length('/srv/' || project || '/') + 1) "
        "else file end as uri, greatest(line, 1) as start_line, greatest(coalesce(\"column\", 1), 1) as start_column, "
        "case when code not in ('', '[REDACTED]') then code end as snippet_text from q0)",
        f"ru as (select *, {SARIF_SCORE} as security_severity from (select *, row_number() over (partition by project, "
        "scan_id, run_rank, rule_key order by seq) as k_ from q) where k_ = 1)",
    ]


def j(x: str) -> str:
    return f"cast(to_json({x}) as varchar)"


RESULT_JSON = (
    f"concat('{{\"ruleId\":', {j('rule_key')}, ',\"level\":\"', level, '\",\"message\":{{\"text\":', {j('description')}, "
    f"'}},\"locations\":[{{\"physicalLocation\":{{\"artifactLocation\":{{\"uri\":', {j('uri')}, "
    "',\"uriBaseId\":\"%SRCROOT%\"},\"region\":{\"startLine\":', start_line, ',\"startColumn\":', start_column, "
    f"case when snippet_text is not null then concat(',\"snippet\":{{\"text\":', {j('snippet_text')}, '}}') else '' end, "
    "'}}}]}')")
RULE_JSON = (
    f"concat('{{\"id\":', {j('rule_key')}, ',\"name\":', {j('title')}, ',\"shortDescription\":{{\"text\":', "
    f"{j('description')}, '}},\"fullDescription\":{{\"text\":', {j('description')}, '}},\"help\":{{\"text\":', {j('fix')}, "
    f"',\"markdown\":', {j('fix')}, '}},\"defaultConfiguration\":{{\"level\":\"', level, '\"}},\"properties\":{{\"tags\":"
    "[\"security\",\"general\"],\"security-severity\":\"', security_severity, '\"}}')")
def chunked(source: str, slot: str, section: int, text: str, glue: str = "','") -> str:
    """Pieces of one slot: findings of a block of seq values, glue before all but the first block."""
    return (
        f"select project, scan_id, slot, {section} as section, chunk, case when chunk = min(chunk) over (partition by "
        f"project, scan_id, slot) then body else {glue} || body end as text from (select project, scan_id, {slot} as slot, "
        f"seq // {CHUNK} as chunk, string_agg({text}, {glue} order by seq) as body from {source} group by all)")


def esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


CARD = (
    f"concat('<article class=\"finding ', {esc('severity')}, '\"><h3>', {esc('title')}, ' <em>', {esc('severity')}, "
    f"'</em></h3><p>', {esc('description')}, '</p><p>📁 ', {esc('file')}, ':', line, '</p>', "
    f"case when code <> '' then concat('<pre>', {esc('code')}, '</pre>') else '' end, "
    f"case when fix <> '' then concat('<p>Fix: ', {esc('fix')}, '</p>') else '' end, '</article>')")
SECTIONS_SQL = (
    "select project, scan_id, rnk + 1 as slot, 0 as section, cast(0 as bigint) as chunk, '<section><h2>' || case rnk when 0 then "
    "'🔴 Critical Vulnerabilities' when 1 then '🟠 High Severity Issues' else '🟡 Medium Severity Issues' end || '</h2>' "
    "as text from d where rnk < 3 group by project, scan_id, rnk union all select project, scan_id, rnk + 1, "
    "2, 0, '</section>' from d where rnk < 3 group by project, scan_id, rnk union all "
    + chunked("(select * from d where rnk < 3)", "rnk + 1", 1, CARD, "chr(10)"))

TOTAL = "(critical_count + high_count + medium_count + low_count)"
SUMMARY_TEXT = (
    "'Security scan completed on ' || {p} || '. ' || case when " + TOTAL + " = 0 then '✅ No vulnerabilities detected. "
    "The codebase appears to follow security best practices.' else 'Identified ' || " + TOTAL + " || ' security issues "
    "across the codebase. ' || case when critical_count > 0 then '⚠️ ' || critical_count || ' critical vulnerabilities "
    "require immediate attention. ' else '' end || 'Review detailed findings below and implement recommended fixes.' end")
ADVICE = (
    "list_filter([case when critical_count > 0 then '🔴 Address all CRITICAL vulnerabilities immediately (within 24 hours)' "
    "end, case when high_count > 0 then '🟠 Remediate HIGH severity issues within 48 hours' end, "
    "case when secrets_found > 0 then '🔐 Rotate any exposed credentials and remove from codebase' end, "
    "case when outdated_dependencies > 0 then '📦 Update vulnerable dependencies to patched versions' end, "
    "case when medium_count > 0 then '🟡 Plan fixes for MEDIUM severity issues within 1-2 weeks' end, "
    "'✅ Integrate security scanning into CI/CD pipeline', '📚 Review OWASP Top 10 guidance for development team'], "
    "lambda x: x is not null)")
RISK_TEXT = ("case when linear_score >= 75 then '🔴 Critical - Immediate remediation required' when linear_score >= 50 then "
             "'🟠 High - Address vulnerabilities within 24-48 hours' when linear_score >= 25 then "
             "'🟡 Medium - Plan remediation within 1-2 weeks' else "
             "'🟢 Low - Minor issues, address during regular maintenance' end")
RISK_CLASS = ("case when linear_score >= 75 then 'risk-high' when linear_score >= 50 then 'risk-medium' "
              "else 'risk-low' end")

LABEL = ("case t when 1 then 'Python (Bandit)' when 2 then 'Python Dependencies (pip-audit)' when 3 then case when ts "
         "then 'JavaScript/TypeScript (ESLint)' else 'JavaScript (ESLint)' end when 4 then 'Secrets Detection' "
         "when 5 then 'Semgrep SAST' else 'Dependencies (npm audit)' end")
PLAN_NO = ("case tool when 'Bandit' then 1 when 'pip-audit' then 2 when 'ESLint' then 3 when 'Secret Scanner' then 4 "
           "when 'Semgrep' then 5 else 6 end")
PERFORMED = [
    "tsx as (select project, scan_id, coalesce(bool_or(tool = 'ESLint' and unit like '%.ts'), false) as ts from r "
    "group by all)",
    f"ran as (select distinct project, scan_id, {PLAN_NO} as t from r)",
    f"perf as (select project, scan_id, cast(count(*) as int) as n_scans, string_agg({LABEL}, '|' order by t) as "
    "scans_performed from ran join tsx using (project, scan_id) group by all)",
]
N_PATHS = "case when kind = 'report' then event_id % 4 + 1 else 0 end"
FILES_SCANNED = (
    f"fs as (select project, scan_id, cast(sum(case when {OK} then case when tool in ('Bandit','ESLint') then file_count "
    f"when tool = 'Semgrep' then {N_PATHS} else 0 end else 0 end) as bigint) as files_scanned from r group by all)")
DURATION = "round_even({x}, 1) || ' seconds'"
# Seconds in which at least one run was under way: runs begin at full hours.
ELAPSED = [
    "sp as (select project, scan_id, epoch(date_trunc('hour', ts)) as a, epoch(date_trunc('hour', ts)) + duration_s as b "
    "from r join events on events.event_id = r.run_no where duration_s > 0)",
    "du0 as (select project, scan_id, greatest(0, b - greatest(a, coalesce(max(b) over (partition by project, scan_id order by a, b "
    "rows between unbounded preceding and 1 preceding), a))) as n from sp)",
    "du as (select project, scan_id, coalesce(sum(n), 0) as dur from (select project, scan_id, n from du0 union all "
    "select project, scan_id, 0 from r) group by all)"]
STDERR = strip("coalesce(stderr,'')")
FAILURE = (
    "case when not target_exists and tool <> 'pip-audit' then 'Target path does not exist' "
    "when timed_out then tool || ' scan timed out' "
    f"when tool = 'Bandit' and {STDERR} <> '' and exit_code not in (0,1) then 'Bandit error: ' || {STDERR} "
    "when tool = 'Semgrep' and exit_code in (2,3) then 'Semgrep error (code ' || exit_code || '): ' || coalesce(stderr,'') "
    "when tool <> 'pip-audit' and kind in ('bad','space') then 'Failed to parse ' || tool || ' output' end")
STATUS = f"rs as (select *, {FAILURE} as error from r)"

SQL: dict[str, str] = {}


def put(name: str, ctes: list[str], select: str) -> None:
    SQL[name] = (with_(*ctes) if ctes else "") + select


# --- sources ---
put("file_inventory", FILES, "select project, path, rel_path, language, excluded_dir from fl where language is not null")
put("read_bandit", BANDIT, f"select {RK}, cast(pos as int) as pos, test_id, test_name, issue_severity, issue_confidence, "
    "issue_text, filename, line_number, col_offset, code, more_info from x")
put("read_pip_audit", PIP, f"select {RK}, pos, name as package, version as installed_version, vid as vulnerability_id, "
    "severity, description, replace(fixes, ', ', '|') as fix_versions, alias as aliases, unit as source_file from x")
put("read_npm_audit", NPM, f"select {RK}, cast(pos as int) as pos, package, severity, via, version_range, fix_available from x")
put("read_eslint", ESLINT, f"select {RK}, message_no, file, line, \"column\", severity, message, rule_id from x")
put("read_semgrep", SEMGREP, f"select {RK}, cast(pos as int) as pos, rule_id, file, line, col as \"column\", end_line, "
    "9 as end_column, lines as code, coalesce(confidence,'MEDIUM') as confidence, coalesce(category,'security') as category, "
    "tech_txt as technology from x")
put("read_secrets", SECRETS, f"select {RK}, cast(pos as int) as pos, \"type\", severity, description, file, line from x")
put("scan_envelope", [RUNS], f"select {RK}, tool, unit, {OK} as success, exit_code, case when kind in ('blank','space') then "
    f"'empty' when kind = 'bad' then 'raw' else 'report' end as data_kind, case when kind = 'bad' then {lit(fx.BAD)} end as "
    f"raw_output, case when {OK} then null when exit_code = 124 then 'Scan timeout after 5 minutes' when exit_code = 2 and "
    "kind in ('blank','space') then 'Error running scanner' else 'Unknown error' end as error, coalesce(stderr,'') as stderr from r")
put("read_results_doc", [], """
select event_id as doc_id, case when event_id % 5 = 0 then '/srv' else '.' end as target_path, cast(pos as int) as pos, tool,
 'T' || (user_id % 4) as title
from events join (values (0,0,'Bandit'),(0,1,'Semgrep'),(1,0,'Bandit'),(1,1,'ESLint'),(2,0,'Bandit'),(2,1,'Secret Scanner'),
 (3,0,'Secret Scanner'),(3,1,'Bandit')) h(kind, pos, tool) on h.kind = event_id % 5""")
put("dependency_manifests", FILES, """
select project, coalesce(string_agg(rel_path, '|' order by o) filter (o > 0), '') as manifests,
 cast(count(*) filter (o > 0) as int) as n_manifests
from (select *, case rel_path when 'requirements.txt' then 1 when 'requirements-dev.txt' then 2 when 'pyproject.toml' then 3
 else 0 end as o from fl) group by project""")
put("npm_project_dirs", FILES, "select project, left(path, length(path) - length('/package.json')) as project_dir from inc "
    "where is_pkg")

# --- sinks ---
put("sink_json", [*HALVES, SCORES, PRE], f"""
select project, scan_id, 0 as slot, 0 as section, cast(0 as bigint) as chunk, concat('{{"project_name":"', project, '","critical_count":', critical_count,
 ',"high_count":', high_count, ',"medium_count":', medium_count, ',"low_count":', low_count, ',"secrets_found":',
 secrets_found, ',"outdated_dependencies":', outdated_dependencies, ',"raw_risk_score":', raw_risk_score,
 ',"all_vulnerabilities":[') as text from s join p using (project, scan_id)
union all select project, scan_id, slot, 0, 0, t from c, (values (2, '],"critical_vulnerabilities":['),
 (3, '],"high_vulnerabilities":['), (4, '],"medium_vulnerabilities":['), (5, '],"low_vulnerabilities":['), (6, ']}}')) h(slot, t)
union all {{all}} union all {{lists}}""".replace("{all}", chunked("d", "1", 1, "@J")).replace(
    "{lists}", chunked("d", "rnk + 2", 1, "@J")).replace("@J", (
        f"concat('{{\"tool\":\"', tool, '\",\"severity\":\"', severity, '\",\"title\":', {j('title')}, ',\"description\":', "
        f"{j('description')}, ',\"file\":', {j('file')}, ',\"line\":', line, case when \"column\" is not null then "
        f"concat(',\"column\":', \"column\") else '' end, ',\"code\":', {j('code')}, ',\"fix\":', {j('fix')}, "
        f"case when rule_id is not null then concat(',\"rule_id\":', {j('rule_id')}) else '' end, "
        "case when tool = 'Semgrep' then concat(',\"owasp\":', cast(to_json(list_filter([owasp_1, owasp_2], "
        "lambda x: x is not null)) as varchar)) else '' end, '}')")))
SQL["sink_json"] = SQL["sink_json"].replace("{select", "select").replace("]}}')) h(slot", "]}')) h(slot")
put("sarif_results", [*fnd(), *sarif_rows("f")], "select project, scan_id, seq, run_name, rule_key, level, description as "
    "message_text, uri, start_line, start_column, snippet_text from q")
put("sarif_document", [*HALVES, *sarif_rows("d"),
    "present as (select project, scan_id, run_rank, run_name, min(run_rank) over (partition by project, scan_id) as first_ from "
    "(select distinct project, scan_id, run_rank, run_name from q))"], f"""
select project, scan_id, 0 as slot, 0 as section, cast(0 as bigint) as chunk, '{{"$schema":"{SCHEMA_URI}","version":"2.1.0","runs":[' as text from c
union all select project, scan_id, 6, 0, 0, ']}}' from c
union all select project, scan_id, run_rank, 0, 0, case when run_rank = first_ then '' else ',' end ||
 '{{"tool":{{"driver":{{"name":"' || run_name || '","version":"' || case run_rank when 1 then '1.7.5' else '1.0.0' end ||
 '","rules":[' from present
union all select project, scan_id, run_rank, 2, 0, ']}}}},"results":[' from present
union all select project, scan_id, run_rank, 4, 0, ']}}' from present
union all """ + chunked("ru", "run_rank", 1, RULE_JSON) + " union all "
    + chunked("q", "run_rank", 3, RESULT_JSON))
put("html_sections", HALVES, SECTIONS_SQL)


def bar(name: str) -> str:
    n, pct = f"{name}_count", f"round_even({name}_count / {TOTAL} * 100, 1)"
    return (f"case when {n} > 0 then concat('<div class=\"bar {name}\" style=\"width: ', {pct}, '%\">{name.capitalize()}: ', "
            f"{n}, ' (', {pct}, '%)</div>') end")


CHART = ("array_to_string(list_filter([" + ", ".join(bar(b) for b in ("critical", "high", "medium", "low"))
         + "], lambda x: x is not null), chr(10))")
PAGE = [*HALVES, SCORES, PRE, RUNS, *PERFORMED, FILES_SCANNED,
        "du as (select project, scan_id, sum(duration_s) as dur from r group by all)"]
put("html_report", PAGE, f"""
select project, scan_id, 0 as slot, 0 as section, cast(0 as bigint) as chunk, concat('<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>', project,
 '</title></head><body><h1>Security Assessment Report</h1><p>', project, '</p><p>Generated: 2024-01-31 00:00:00</p>',
 '<div class="card"><h3>Total Vulnerabilities</h3><b>', {TOTAL}, '</b></div><div class="card"><h3>Critical Issues</h3><b>',
 critical_count, '</b></div><div class="card"><h3>Files Scanned</h3><b>', files_scanned,
 '</b></div><div class="card"><h3>Risk Score</h3><b>', linear_score, '</b></div><h2>Severity Distribution</h2>', {CHART},
 '<h2>Executive Summary</h2><p>', {esc(SUMMARY_TEXT.format(p='project'))}, '</p><p class="', {RISK_CLASS}, '">', linear_score,
 '/100 ', {RISK_TEXT}, '</p>') as text from s join fs using (project, scan_id)
union all select project, scan_id, 4, 0, 0, concat('<h2>Recommendations</h2><ul>',
 array_to_string(list_transform({ADVICE}, lambda x: '<li>' || x || '</li>'), chr(10)),
 '</ul><h2>Scan Details</h2><p><strong>Target:</strong> /srv/', project, '</p><p><strong>Scan Tools:</strong> ',
 replace(scans_performed, '|', ', '), '</p><p><strong>Scan Duration:</strong> ', {DURATION.format(x='dur')},
 '</p><p><strong>Languages Detected:</strong> Python, TypeScript</p></body></html>')
 from s join p using (project, scan_id) join perf using (project, scan_id) join du using (project, scan_id)
union all {SECTIONS_SQL}""")
put("scan_summary", [
    *ALL, f"f as (select *, {BUCKET} as bucket, concat(file, ':', line, ':', tool, ':', coalesce(rule_id, title)) as fp from u "
    f"where {OK})", DED, COUNTS, PRE, "sk as (select distinct project, scan_id from r)",
    "c2 as (select project, scan_id, coalesce(critical_count,0) as critical_count, coalesce(high_count,0) as high_count, "
    "coalesce(medium_count,0) as medium_count, coalesce(low_count,0) as low_count, coalesce(total,0) as total, "
    "coalesce(secrets_found,0) as secrets_found, coalesce(outdated_dependencies,0) as outdated_dependencies from sk left join c "
    "using (project, scan_id) left join p using (project, scan_id))", SCORES.replace("from c)", "from c2)"), *PERFORMED,
    FILES_SCANNED, *ELAPSED],
    f"select s.*, {LEVEL} as risk_level, n_scans, scans_performed, files_scanned, {DURATION.format(x='dur')} as scan_duration "
    "from s join perf using (project, scan_id) join fs using (project, scan_id) join du using (project, scan_id)")
put("format_selection", [f"pol as ({policy_sql()})"], "select project, " + ", ".join(
    f"list_contains(string_split(formats, '|'), '{f}') as write_{f}" for f in ("text", "json", "html", "sarif")) + " from pol")

# --- projections ---
put("normalize_severity", fnd(), f"select seq, {norm('severity_raw')} as severity from raw")
put("normalize_findings", BANDIT, f"""select project, scan_id, {SEQ} as seq, 'Bandit' as tool, sev as severity,
 case when title is not null then title else coalesce(test_name, 'Security Issue') end as title, issue_text as description,
 coalesce(filename,'unknown') as file, line_number as line, col_offset as "column", code, more_info as fix,
 coalesce(test_id,'') as rule_id from x""")
put("project_pip_audit", PIP, f"""select project, scan_id, {SEQ} as seq, 'pip-audit' as tool, severity,
 'Vulnerable package: ' || name as title, vid || ': ' || description as description, unit as file, 0 as line,
 name || '==' || version as code, case when fixes <> '' then 'Upgrade to: ' || fixes else 'No fix available' end as fix,
 vid as rule_id from x""")
put("project_npm", NPM, f"""select project, scan_id, {SEQ} as seq, 'npm audit' as tool, {norm('severity')} as severity,
 'Vulnerable package: ' || package as title, 'Version range: ' || version_range as description, 'package.json' as file,
 0 as line, '' as code, case when fix_available = 'false' then 'No fix available' else 'Fix available' end as fix from x""")
put("redact_secrets", SECRETS, f"""select project, scan_id, {SEQ} as seq, 'Secret Scanner' as tool,
 {norm("coalesce(severity,'high')")} as severity, 'Exposed secret: ' || coalesce("type",'Unknown') as title,
 coalesce(description, 'Hardcoded secret detected') as description, file, line, '[REDACTED]' as code,
 'Remove from code and use environment variables or secret manager' as fix from x""")
put("project_semgrep", SEMGREP, f"""select {RK}, cast(pos as int) as pos, rule_id, title, severity,
 coalesce(msg, 'Security issue detected') || tax as message, coalesce(msg,'') as description, file, line,
 coalesce(fix,'') as fix, refs_txt as "references", replace(cwe_txt, ', ', '|') as cwe, replace(owasp_txt, ', ', '|') as owasp,
 taint as is_taint_finding, case when has_src then 'in.py' end as source_file, case when has_src then 3 end as source_line,
 case when has_src then 'req' end as source_content, case when has_sink then 'out.py' end as sink_file,
 case when has_sink then 0 end as sink_line, case when has_sink then 'run' end as sink_content from x""")
put("semgrep_severity", fnd(), f"select seq, case upper(coalesce({strip('severity_raw')}, 'WARNING')) when 'ERROR' then 'high' "
    "when 'INFO' then 'low' else 'medium' end as severity from raw")
put("eslint_severity", [], "select event_id as seq, case when event_id % 5 = 2 then 'high' when event_id % 5 in (1, 4) then "
    "'medium' else 'low' end as severity from events")
put("pip_audit_severity", PIP, f"select {RK}, pos, vid as vulnerability_id, severity from x")
put("taxonomy_enrich", SEMGREP, f"select {RK}, cast(pos as int) as pos, coalesce(msg,'') || tax as description from x")
put("taint_annotate", SEMGREP, f"select {RK}, cast(pos as int) as pos, taint as is_taint_finding, prefix || coalesce(msg,'') "
    "as description from x")
put("finding_fingerprint", fnd(), "select seq, fp as fingerprint from f")
put("sarif_level", fnd(), f"select seq, case when seq % 9 = 0 then 'note' else {SARIF_LEVEL} end as level from f")
put("sarif_score", fnd(), f"select seq, case when seq % 9 = 0 then '0.0' when seq % 9 = 1 then '5.0' else {SARIF_SCORE} end as "
    "score from f")
put("relative_uri", fnd(), "select seq, case when seq % 11 in (0, 1, 2) then 'unknown' when file like '/srv/proj' || (seq % 10) "
    "|| '/%' then substr(file, 12) else list_last(string_split(file, '/')) end as uri from f")
put("region_clamp", fnd(), 'select seq, greatest(line - 2, 1) as start_line, greatest(coalesce("column", 1), 1) as start_column '
    "from f")
put("snippet_filter", fnd(), "select seq, case when code <> '' and code <> '[REDACTED]' then code end as snippet from f")
put("risk_level", HOURLY, f"select project, scan_id, risk_score, {LEVEL} as risk_level from s")
put("risk_text", HOURLY, f"select project, scan_id, {RISK_TEXT} as description, {RISK_CLASS} as css_class from s")
put("html_escape", fnd(), f"select seq, {esc('description')} as description from f")
put("executive_summary", HOURLY, f"select project, scan_id, {SUMMARY_TEXT.format(p='project')} as summary from c")
put("recommendations", [*HOURLY, PRE], f"""select project, scan_id, cast(pos - 1 as int) as pos, a[pos] as advice from
 (select *, unnest(range(1, len(a) + 1)) as pos from (select project, scan_id, {ADVICE} as a from c join p
 using (project, scan_id)))""")
put("scan_label", FILES, "select project, case when ts_files > 0 then 'JavaScript/TypeScript (ESLint)' else "
    "'JavaScript (ESLint)' end as scan_name from lang")
put("format_duration", [RUNS], f"select {RK}, {DURATION.format(x='duration_s')} as scan_duration from r")
put("tool_status", [RUNS, STATUS], f"select {RK}, tool, error is null as success, error from rs")
put("scan_warnings", [RUNS, STATUS], f"select {RK}, tool, {STDERR} as warnings from rs where tool in "
    f"('Bandit','ESLint','npm audit') and error is null and {STDERR} <> ''")
put("project_name", [], f"select event_id, {fx.PROJECT} as project_name, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') as timestamp "
    "from events")

# --- filters ---
put("exclude_dirs", FILES, "select project, path from fl where not excluded_dir")
put("exclude_globs", FILES, r"""select project, path from fl where not coalesce(case app % 4
 when 1 then path like '%/lib/%'
 when 2 then rel_path like 'tests/%' or path like '%.tsx'
 when 3 then regexp_full_match(rel_path, 'src/f.[0-4].*') or regexp_full_match(path, '[^s].*/f.*9\.py')
  or regexp_full_match(rel_path, '[^s].*/f.*9\.py') end, false)""")
put("security_rule_filter", ESLINT, f"select {RK}, message_no, file, line, \"column\", severity, message, rule_id from x where "
    "contains(rule_id, 'security/')")
APP_COLS = cols({k: v for k, v in fx.APP_POLICY.items()})
put("scan_plan", [*FILES, f"ap as (select {fx.APP_NAME} as project, {APP_COLS} from part where p_partkey % 40 = 0)",
    "pl as (select ap.*, coalesce(python_files,0) > 0 as py, coalesce(js_files,0) + coalesce(ts_files,0) > 0 as js, "
    "coalesce(ts_files,0) > 0 as ts from ap left join lang using (project))"], """
select project, 'Bandit' as tool, 'Python (Bandit)' as scan_name, cast(null as varchar) as unit from pl where py and python
union all select project, 'pip-audit', 'Python Dependencies (pip-audit)', null from pl where py and dependencies
union all select project, 'ESLint', case when ts then 'JavaScript/TypeScript (ESLint)' else 'JavaScript (ESLint)' end, null
 from pl where js and javascript
union all select project, 'Secret Scanner', 'Secrets Detection', null from pl where secrets
union all select project, 'Semgrep', 'Semgrep SAST', null from pl where semgrep
union all select project, 'npm audit', 'Dependencies (npm audit)', left(path, length(path) - 13) from inc join ap using (project)
 where is_pkg and dependencies""")
put("successful_scans", ALL, f"select project, scan_id, seq, tool, severity, title from u where {OK}")
put("vulnerable_dependencies", PIP, f"select {RK}, unit, name as package, version as installed_version, cast(n_vulns as int) as "
    "n_vulns from dep where n_vulns > 0")
put("not_installed_errors", [RUNS], f"""select {RK}, tool, error, case when contains(error, 'not installed') then 'skipped' else
 'failed' end as outcome from (select *, coalesce(nullif({STDERR}, ''), 'Unknown error') as error from r where not ({OK}))""")
put("tool_partition", [*fnd(), f"q0 as (select seq, {RUN_RANK} as run_rank from f where seq % 13 <> 0)"],
    f"select seq, run_rank, {RUN_NAME} as run_name from q0")
put("node_modules_ts", FILES, "select project, coalesce(bool_or(language = 'typescript' and path not like '%node_modules%'), "
    "false) as has_typescript from fl group by project")
put("eslint_ignore", FILES, "select project, path, language from fl where language in ('javascript','typescript') and rel_path not "
    "like 'node_modules/%' and rel_path not like 'build/%'")
put("minimum_severity", [*fnd(), SETTINGS], """select f.project, seq, severity from f left join st using (project)
 where rnk <= case coalesce(minimum, 'low') when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end""")
put("include_patterns", FILES, "select project, path from fl where app % 3 <> 1 or path like '%.py'")
put("suppress_findings", HALVES, "select project, scan_id, seq, fp as fingerprint from d where not exists (select 1 from f where "
    "f.seq % 20 = 3 and f.project = d.project and f.fp = d.fp)")

# --- joins ---
SQL["effective_policy"] = policy_sql()
put("owasp_rollup", [*fnd(), "lab as (select distinct seq, project, o from (select seq, project, owasp_1 as o from f union all "
    "select seq, project, owasp_2 from f) where o is not null)",
    "cat(category, category_name) as (values " + ", ".join(f"('{a}', {lit(b)})" for a, b in OWASP_CATEGORIES) + ")"], """
select k.project, category, category_name, count(lab.seq) as n_findings from (select distinct project from f) k cross join cat
 left join lab on lab.project = k.project and lab.o like category || '%' group by all""")
put("remediation_lookup", [*FILES, snippet_hits(),
    "rem(family, secure_pattern) as (values " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in REMEDIES) + ")",
    "cat(category, category_name) as (values " + ", ".join(f"('{a}', {lit(b)})" for a, b in OWASP_CATEGORIES) + ")"],
    "select path, line, rule_id, family, owasp || ':2021 - ' || category_name as owasp_category, secure_pattern from hits "
    "join rem using (family) join cat on cat.category = hits.owasp")

# --- aggregations ---
put("dedup_findings", HALVES, 'select project, scan_id, seq, tool, severity, title, description, file, line, "column", code, fix, '
    "rule_id, case when tool = 'Semgrep' then array_to_string(list_filter([owasp_1, owasp_2], lambda x: x is not null), '|') end "
    "as owasp from d")
put("severity_buckets", HOURLY, "select * from c")
put("bandit_breakdown", BANDIT, f"select {RK}, count(*) filter (issue_severity='HIGH') as high, count(*) filter "
    f"(issue_severity='MEDIUM') as medium, count(*) filter (issue_severity='LOW') as low from x group by all")
put("semgrep_breakdown", SEMGREP, f"select {RK}, cast(0 as bigint) as critical, count(*) filter (severity='high') as high, count(*) filter "
    "(severity='medium') as medium, count(*) filter (severity='low') as low from x group by all")
NPM_META = cols(fx.NPM_META)
put("npm_breakdown", [RUNS], f"""select {RK}, {', '.join(f"case when m then cast({fx.NPM_META[n]} as int) else 0 end as {n}"
 for n in ('critical', 'high', 'moderate', 'low'))}, case when m then {fx.NPM_META['total']} else 0 end as total_issues,
 case when m then cast(event_id % 100 as varchar) else '0' end as dependencies
 from (select *, kind = 'report' and {fx.NPM_HAS_META} as m from r) where tool = 'npm audit' and kind in ('report','blank')""")
put("semgrep_multi_config", [*SEMGREP, STATUS,
    "ok as (select * from rs where tool = 'Semgrep' and error is null)",
    "fx1 as (select x.*, row_number() over (partition by x.project, x.scan_id, x.file, x.line, x.rule_id order by x.run_no, x.pos) "
    "as k_ from x join ok on ok.run_no = x.run_no)",
    "fc as (select project, scan_id, count(*) filter (severity='high') as high, count(*) filter (severity='medium') as medium, "
    "count(*) filter (severity='low') as low, count(*) as total_issues from fx1 where k_ = 1 group by all)",
    "pc as (select project, scan_id, count(distinct project || '/s' || jj) as files_scanned from (select *, "
    "unnest(range(event_id % 4 + 1)) as jj from ok where kind = 'report') group by all)",
    "ec as (select project, scan_id, sum(n) as n_errors, sum(m) as n_errors_total from (select project, scan_id, "
    "case when kind = 'report' and event_id % 5 = 0 then 10 else 0 end as n, "
    "case when kind = 'report' and event_id % 5 = 0 then 12 else 0 end as m from ok union all select project, scan_id, 1, 1 from rs where tool = 'Semgrep' and error is not "
    "null and not contains(error, 'not installed')) group by all)"], """
select k.project, k.scan_id, cast(0 as bigint) as critical, coalesce(high,0) as high, coalesce(medium,0) as medium,
 coalesce(low,0) as low, coalesce(total_issues,0) as total_issues, coalesce(files_scanned,0) as files_scanned,
 cast(coalesce(n_errors,0) as bigint) as n_errors, cast(coalesce(n_errors_total,0) as bigint) as n_errors_total
from (select distinct project, scan_id from r where tool = 'Semgrep') k left join fc using (project, scan_id)
 left join pc using (project, scan_id) left join ec using (project, scan_id)""")
put("semgrep_merged_findings", [*SEMGREP, STATUS,
    "ok as (select * from rs where tool = 'Semgrep' and error is null)",
    "fx1 as (select x.*, row_number() over (partition by x.project, x.scan_id, x.file, x.line, x.rule_id order by x.run_no, x.pos) "
    "as k_ from x join ok on ok.run_no = x.run_no)"],
    f"select project, scan_id, {SEQ} as seq, severity, title, file, line, rule_id from fx1 x where k_ = 1")
put("files_scanned", [RUNS, FILES_SCANNED,
    "fd as (select project, scan_id, count(distinct jj) as files_distinct from (select *, unnest(range(event_id % 4 + 1)) as jj "
    f"from r where tool = 'Semgrep' and kind = 'report' and {OK}) group by all)"],
    "select fs.*, coalesce(files_distinct, 0) as files_distinct from fs left join fd using (project, scan_id)")
put("secret_and_dependency_counts", [*fnd(fx.HOUR), PRE], "select * from p")
put("scans_performed", [RUNS, *PERFORMED], "select * from perf")
put("risk_score", HOURLY, f"select project, scan_id, critical_count, high_count, medium_count, low_count, raw_risk_score, "
    f"risk_score, {LEVEL} as risk_level from s")
put("risk_score_linear", HOURLY, "select project, scan_id, linear_score from s")
put("risk_weighted", [*HOURLY, SETTINGS], "select c.project, scan_id, least(critical_count * coalesce(w_critical, 25) + high_count "
    "* coalesce(w_high, 10) + medium_count * coalesce(w_medium, 3) + low_count * coalesce(w_low, 1), 100) as weighted_score from c "
    "left join st using (project)")
put("build_gate", [*HOURLY, SETTINGS], """select c.project, scan_id, coalesce(fail_on, 'high') as fail_on,
 case lower(coalesce(fail_on, 'high')) when 'critical' then critical_count > 0 when 'high' then critical_count + high_count > 0
 when 'medium' then critical_count + high_count + medium_count > 0 else false end as build_fails
 from c left join st using (project)""")
put("severity_distribution", HALVES, f"""select project, scan_id, severity_rank, severity, n, n / total * 100 as pct,
 round_even(n / total * 100, 1) as pct_rounded from (select project, scan_id, total, unnest([0,1,2,3]) as severity_rank,
 unnest(['critical','high','medium','low']) as severity, unnest([critical_count, high_count, medium_count, low_count]) as n
 from c) where n > 0""")
put("sarif_rules", [*fnd(), *sarif_rows("f")], "select project, scan_id, seq, run_name, rule_key, title as name, description as "
    "description_text, fix as help_text, fix as help_markdown, level, 'general' as category, security_severity from ru")
put("taint_count", SEMGREP, "select project, scan_id, count(*) filter (taint) as taint_findings from x group by all")
put("project_languages", FILES, "select project, python_files > 0 as python, js_files + ts_files > 0 as javascript, ts_files > 0 "
    "as typescript, package_json_files > 0 as nodejs, python_files, js_files, ts_files, package_json_files from lang")
put("total_issues", fnd(fx.HOUR), "select project, scan_id, tool, count(*) as total_issues from f group by all")
put("exit_status", [*ALL, STATUS,
    "lc as (select seq // 4294967296 as run_no, tool, count(*) as n from u where tool <> 'npm audit' group by all)",
    f"tt as (select rs.*, case when rs.tool = 'npm audit' then case when kind = 'report' and {fx.NPM_HAS_META} then "
    f"{fx.NPM_META['total']} else 0 end else coalesce(n, 0) end as total_issues from rs left join lc on lc.run_no = rs.run_no)"],
    f"select {RK}, tool, cast(total_issues as int) as total_issues, case when error is not null then 2 when total_issues > 0 then "
    "1 else 0 end as exit_status from tt")

# --- windows ---
put("top_n_per_severity", fnd(), """select project, scan_id, severity, cast(rk as int) as rank, seq, greatest(n - 10, 0) as more
 from (select *, row_number() over (partition by project, scan_id, severity order by seq) as rk,
 count(*) over (partition by project, scan_id, severity) as n from f where severity in ('critical','high','medium','low'))
 where rk <= 10""")
put("top_n_packages", NPM, f"""select project, scan_id, cast(rk as int) as rank, seq, package, upper(severity) as severity,
 greatest(n - 20, 0) as more from (select *, {SEQ} as seq, row_number() over (partition by project, scan_id order by run_no, pos)
 as rk, count(*) over (partition by project, scan_id) as n from x) where rk <= 20""")
put("numbered_findings", fnd(), "select project, scan_id, tool, seq, row_number() over (partition by project, scan_id, tool order "
    "by seq) as number from f")
put("error_sample", [RUNS], f"""select {RK}, cast(pos as int) as pos, 'err ' || pos as message, case when pos % 2 = 0 then
 'f' || pos || '.py' else '' end as path from (select *, unnest(range(10)) as pos from r where tool = 'Semgrep' and
 kind = 'report' and event_id % 5 = 0)
union all select {RK}, -1, case kind when 'bad' then {lit(fx.BAD)} else '  ' || chr(10) end, '' from r where tool = 'Semgrep'
 and kind in ('bad','space')""")
put("message_preview", [], "select doc_id, substr(text, 1, 100) || '...' as preview from documents")
put("severity_order", fnd(), "select project, scan_id, rnk as severity_rank, seq from f order by 1, 2, 3, 4")
put("remediation_priority", [*HALVES, """pr as (select *, case when bucket = 'critical' then 1
 when tool in ('pip-audit','npm audit') and fix <> 'No fix available' then 5 else 6 end as priority from d)"""], """
select project, scan_id, seq, priority, 'VULN-' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else
 cast(n as varchar) end as vuln_id from (select *, row_number() over (partition by project, scan_id order by priority, seq) as n
 from pr)""")
put("primary_concerns", fnd(), """select project, title, n_findings, cast(rk as int) as rank from (select *, row_number() over
 (partition by project order by n_findings desc, title) as rk from (select project, title, count(*) as n_findings from f
 group by all)) where rk <= 3""")

# --- sets ---
put("union_findings", ALL, "select project, scan_id, seq, tool, severity, title, file, line, rule_id from u")
put("union_manifests", PIP, "select project, scan_id, list_last(string_split(unit, '/')) as manifest, name as package, vid as "
    "vulnerability_id from x")
put("distinct_paths", [RUNS], "select distinct project, scan_id, '/srv/' || project || '/src/s' || jj as path from (select *, "
    "unnest(range(event_id % 4 + 1)) as jj from r where tool = 'Semgrep' and kind = 'report')")

put("merged_file_counts", [RUNS, "ph as (select project, scan_id, run_no, '/srv/' || project || '/src/s' || jj as path from "
    "(select *, unnest(range(event_id % 4 + 1)) as jj from r where tool = 'Semgrep' and kind = 'report'))"], """
select project, scan_id, run_no, count(distinct path)::bigint as n_files from ph group by all
union all select project, scan_id, null, count(distinct path)::bigint from ph group by project, scan_id
union all select project, null, null, count(distinct path)::bigint from ph group by project""")

# --- extensions ---
put("custom_reader", [], f"""select {fx.PROJECT} as project, {fx.HALF} as scan_id, event_id * 4294967296 + k as seq,
 'Lint' as tool, 'medium' as severity, 'Security Issue' as title, case k when 0 then 'a.go' else 'b.go' end as file,
 cast(case k when 0 then user_id else 2 end as int) as line, 1 as "column", case k when 0 then 'G1' else event_type end as rule_id
 from events, (values (0), (1)) h(k) where event_id % 3 <> 2""")
put("custom_rules", [*FILES, snippet_hits()], """select path, line, rule_id, case when app % 4 <> 1 and rule_id = 'RND02' then
 'high' when app % 4 <> 1 and rule_id = 'SQL03' then 'medium' else severity end as severity from hits
 where not (app % 4 <> 1 and rule_id = 'CRY01')""")

# --- detection ---
put("explode_lines", [], "select doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) as int) as line, "
    "unnest(string_split(text, chr(10))) as content from documents")
SECRETS_FOUND = "with recursive " + ",\n".join(secret_hits())
SQL["secret_detection"] = f"{SECRETS_FOUND}\nselect *, '[REDACTED]' as code, 'Hardcoded secret detected' as description from sec"
put("vulnerable_pattern_scan", [*FILES, snippet_hits()], "select project, path, language, line, rule_id, title, owasp, family, "
    "severity from hits")
put("rule_rescan", [*FILES, snippet_hits()], "select project, path, language, line, rule_id, title, owasp, family, "
    "severity from hits")
SQL["missing_control_scan"] = with_(*FILES) + control_hits()
SQL["secret_type_rollup"] = (
    f"{SECRETS_FOUND}\nselect project, title, count(*) as n_secrets, count(distinct path) as n_files from sec group by all")
