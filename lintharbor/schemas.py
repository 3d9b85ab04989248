"""Column contracts shared by readers, operators and sinks (DDL strings)."""

# One row per tool run. `run_no` numbers the runs of a scan in plan order, which
# makes every "first one wins" rule below reproducible.
SCAN_RUNS = (
    "project string, scan_id string, run_no bigint, tool string, unit string, "
    "exit_code int, stdout string, stderr string, duration_s double, file_count int, "
    "target_exists boolean, timed_out boolean"
)
# A run table may say when each run began and ended: started_at timestamp, ended_at timestamp.

# One row per finding. NULL means "key absent", '' means "present but empty".
FINDINGS = (
    "project string, scan_id string, seq bigint, tool string, severity string, "
    "title string, description string, file string, line int, `column` int, code string, "
    "fix string, rule_id string, cwe array<string>, owasp array<string>, "
    "`references` array<string>"
)
FINDING_COLUMNS = [c.split()[0].strip("`") for c in FINDINGS.split(", ")]

SCAN_KEYS = ["project", "scan_id"]

# The element every tool reader yields: a finding before severity normalisation.
FINDING_ITEM = (
    "struct<pos:int,severity:string,title:string,description:string,file:string,line:int,"
    "column:int,code:string,fix:string,rule_id:string,cwe:array<string>,owasp:array<string>,"
    "references:array<string>,is_taint:boolean>"
)

# Tool report shapes, narrow on purpose: from_json only materialises these fields.
# Polymorphic fields (list or scalar, boolean or object) are read as JSON text.
BANDIT_REPORT = "results array<map<string,string>>"

PIP_DEPENDENCY = (
    "struct<name:string,version:string,vulns:array<struct<id:string,description:string,"
    "aliases:array<string>,fix_versions:array<string>>>>"
)
PIP_LIST = f"array<{PIP_DEPENDENCY}>"
PIP_OBJECT = f"dependencies array<{PIP_DEPENDENCY}>"

NPM_REPORT = (
    "vulnerabilities map<string,struct<severity:string,via:string,range:string,"
    "fixAvailable:string>>"
)
NPM_METADATA = (
    "metadata struct<vulnerabilities:struct<critical:int,high:int,moderate:int,low:int,"
    "total:int>,dependencies:string>"
)

ESLINT_REPORT = (
    "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,"
    "message:string,line:int,column:int>>>>"
)

SEMGREP_RESULT = (
    "struct<check_id:string,path:string,start:struct<line:int,col:int>,"
    "end:struct<line:int,col:int>,extra:struct<message:string,severity:string,lines:string,"
    "fix:string,metadata:struct<cwe:string,owasp:string,references:string,confidence:string,"
    "category:string,technology:string,shortDescription:string>,dataflow_trace:string>>"
)
SEMGREP_REPORT = f"results array<{SEMGREP_RESULT}>"
SEMGREP_PATHS = "paths struct<scanned:array<string>>"
SEMGREP_ERRORS = "errors array<struct<message:string,path:string>>"
SEMGREP_WHOLE = f"{SEMGREP_REPORT}, {SEMGREP_PATHS}, {SEMGREP_ERRORS}"
TRACE = "taint_source string, taint_sink string"
TRACE_END = "location struct<path:string,start:struct<line:int>>, content string"

SECRETS_REPORT = (
    "secrets array<struct<type:string,severity:string,description:string,file:string,line:int>>"
)

# Findings as they appear in a saved result document: every key may be absent.
SAVED_FINDING = (
    "struct<tool:string,severity:string,title:string,description:string,file:string,line:int,"
    "column:int,code:string,fix:string,rule_id:string,type:string,message:string,category:string>"
)
SAVED_RESULT = (
    "target_path string, project_name string, "
    + ", ".join(
        f"{name} array<{SAVED_FINDING}>"
        for name in (
            "all_vulnerabilities",
            "critical_vulnerabilities",
            "high_vulnerabilities",
            "medium_vulnerabilities",
            "low_vulnerabilities",
            "python_vulnerabilities",
            "javascript_vulnerabilities",
            "secrets",
        )
    )
)
