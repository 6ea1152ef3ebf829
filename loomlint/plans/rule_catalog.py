"""Catalogs of line rules by detector, each written from what its rule is to find.

Deprecated APIs are a table of names; how a name is looked for follows from
its kind. Every other rule is a pattern of its own; ids that stand for one
finding share it.
"""

from __future__ import annotations

import re

from ..operators.rules import Rule

JS = ("typescript", "javascript")
PY, GO, JAVA, KT = ("python",), ("go",), ("java",), ("kotlin",)

# Names of deprecated APIs by library, kind and confidence.
STALE = {
    ("node", JS): "new Buffer 0.95|call url.parse 0.85|call fs.exists 0.9|module querystring 0.8|module domain 0.9|module punycode 0.8|use SlowBuffer 0.9",
    ("react", JS): "use componentWillMount 0.95|use componentWillReceiveProps 0.95|use componentWillUpdate 0.95|use getDefaultProps 0.9|use React.createFactory 0.9|use React.DOM 0.9|use findDOMNode 0.9|use this.refs 0.95|call this.isMounted 0.85|use UNSAFE_componentWillMount 0.95|use UNSAFE_componentWillReceiveProps 0.9|use UNSAFE_componentWillUpdate 0.9|use legacyRenderSubtreeIntoContainer 0.7|call ReactDOM.render 0.95|call ReactDOM.hydrate 0.95|call ReactDOM.unmountComponentAtNode 0.95",
    ("vue", JS): "call Vue.set 0.95|call Vue.delete 0.95|call this.$set 0.95|call this.$delete 0.95|call this.$on 0.95|call this.$off 0.95|call this.$once 0.95|use this.$listeners 0.9|use this.$children 0.95|use this.$scopedSlots 0.9|call Vue.filter 0.95|call Vue.directive 0.85|call Vue.component 0.8|call Vue.mixin 0.9|call Vue.use 0.85|new Vue 0.85",
    ("angular", JS): "use HttpClientModule 0.9|use BrowserAnimationsModule 0.9|module @angular/platform-browser-dynamic 0.7|use Renderer 0.85",
    ("python", PY): "import optparse 0.95|import imp 0.95|use collections.MutableMapping 0.9|use collections.MutableSequence 0.9|use collections.MutableSet 0.9|use asyncio.coroutine 0.95|import distutils 0.9|import cgi 0.85",
    ("java", JAVA): "new Date 0.7|use Vector 0.85|use StringBuffer 0.8|call Thread.stop 0.95|call Thread.suspend 0.95|call Thread.resume 0.95|use Hashtable 0.8|call getRuntime().exec 0.7",
    ("go", GO): "call ioutil.ReadFile 0.95|call ioutil.WriteFile 0.95|call ioutil.ReadAll 0.95|call ioutil.TempDir 0.95|call ioutil.TempFile 0.95|call ioutil.ReadDir 0.95|call ioutil.NopCloser 0.95|string io/ioutil 0.95",
    ("kotlin", KT): "use kotlin.coroutines.experimental 0.95|call withDefault 0.5|call print 0.4",
    ("express", JS): "call app.del 0.9|call res.sendfile 0.9|module body-parser 0.85",
    ("next", JS): "module next/image 0.3|module next/legacy/image 0.7|use getInitialProps 0.8|use getServerSideProps 0.3|use getStaticProps 0.3|module next/router 0.7|module next/head 0.7|module next/document 0.7",
    ("prisma", JS): "use rejectOnNotFound 0.9|string beforeExit 0.8",
    ("mongoose", JS): "use useNewUrlParser 0.9|use useUnifiedTopology 0.9|use useCreateIndex 0.9|use useFindAndModify 0.9",
    ("webpack", JS): "use module.loaders 0.95|new webpack.optimize.CommonsChunkPlugin 0.95|new webpack.optimize.UglifyJsPlugin 0.95|new webpack.optimize.DedupePlugin 0.95|new webpack.NamedModulesPlugin 0.9",
    ("nest", JS): "use ApiModelProperty 0.95|call setHost 0.9|call setSchemes 0.9",
    ("typeorm", JS): "call getRepository 0.7|call getConnection 0.85|call getManager 0.85|call getCustomRepository 0.85|new Connection 0.85|call createConnection 0.85",
    ("python-libraries", PY): "import flask.json.jsonify 0.8|import django.conf.urls.url 0.95|import django.utils.encoding.force_text 0.95|import django.utils.encoding.smart_text 0.95|import django.utils.translation.ugettext 0.95|use default_app_config 0.8|use requests.packages.urllib3 0.9|import sqlalchemy.engine_from_config 0.85|call query.get 0.85",
    ("go-libraries", GO): "call gorm.Open 0.85|use RecordNotFound 0.85",
    ("java-libraries", JAVA + KT): "use WebSecurityConfigurerAdapter 0.95|call authorizeRequests 0.8|call antMatchers 0.85|call mvcMatchers 0.85|import org.junit.Test 0.8|use SpringRunner 0.85",
}


def api_pattern(kind: str, name: str) -> str:
    """How an API of a kind stands in a line of code."""
    dotted = r"\s*\.\s*".join(re.escape(p) for p in name.split("."))
    if kind == "new":
        return rf"\bnew\s+{dotted}\b"
    if kind == "call":
        return rf"\b{dotted}\s*\("
    if kind in ("module", "string"):
        return (r"\b(?:import|export|require|from)\b.*" if kind == "module" else "") + rf"[\"']{re.escape(name)}[\"']"
    if kind == "import":
        head, _, last = name.rpartition(".")
        return rf"^\s*(?:import\s+{dotted}\b|from\s+" + (rf"{re.escape(head)}\s+import\b.*\b{re.escape(last)}\b)" if head else rf"{re.escape(last)}\s+import\b)")
    return rf"\b{dotted}\b"


def _stale(group: str, langs: tuple[str, ...], entries: str) -> list[Rule]:
    rows = [e.split(" ") for e in entries.split("|")]
    return [Rule(f"{group}:{i}", api_pattern(kind, name), "warning", float(conf), langs, where="code", category="code-freshness", message=f"deprecated: {name}") for i, (kind, name, conf) in enumerate(rows)]


STALE_RULES = [r for (group, langs), entries in STALE.items() for r in _stale(group, langs, entries)]

ERROR, WARNING, INFO = "error", "warning", "info"


def _rules(langs: tuple[str, ...], where: str, pattern: str, *ids: tuple[str, str, float], excludes=(), window: int = 0, around=(0, 0)) -> list[Rule]:
    """One rule for each (id, severity, confidence) that stands for what ``pattern`` finds."""
    return [Rule(i, pattern, sev, conf, langs, excludes, window, around, where) for i, sev, conf in ids]


#: Where a value comes from outside the code, it isn't written there.
_OUTSIDE = (r"(?i)\benv\b|environ|getenv|\bconfig\b|vault",)

SECURITY_RULES = [
    # credentials in literals
    *_rules((), "code", r"(?i)\bapi[_ .-]?(?:key|secret|token)\w*['\"]?\s*[:=]{1,2}\s*['\"`][\w.+/=-]{16,}['\"`]", ("hardcoded-api-key", ERROR, 0.85)),
    *_rules((), "code", r"(?i)\b\w*(?:passw(?:or)?d|passphrase|pwd|secret)['\"]?\s*[:=]{1,2}\s*(?:\"[^\"]{4,}\"|'[^']{4,}'|`[^`$]{4,}`)", ("hardcoded-password", ERROR, 0.8), excludes=_OUTSIDE),
    *_rules((), "code", r"(?i)\b(?:auth|access|bearer|refresh|session|jwt)[_-]?(?:token|secret)\w*['\"]?\s*[:=]{1,2}\s*['\"`][\w.~+/=-]{16,}['\"`]", ("hardcoded-token", ERROR, 0.85)),
    *_rules((), "code", r"\bA(?:KIA|SIA|BIA|CCA)[0-9A-Z]{16}\b", ("aws-access-key", ERROR, 0.95)),
    *_rules((), "code", r"-{5}BEGIN (?:[A-Z]+ )*PRIVATE KEY", ("private-key", ERROR, 0.95)),
    *_rules((), "code", r"(?i)\b(?:\w*secret|\w*passw(?:or)?d|\w*key)['\"]?\s*[:=]{1,2}\s*['\"`][^'\"`]{4,}", ("placeholder-secret-very-basic", INFO, 0.4), excludes=_OUTSIDE),
    *_rules((), "code", r"(?i)\b\w*(?:secret|passw(?:or)?d)['\"]?\s*[:=]{1,2}\s*['\"`][^'\"`]*(?:demo|sample|test|example)", ("placeholder-secret-basic", WARNING, 0.8)),
    *_rules((), "code", r"(?i)\b\w*(?:secret|passw(?:or)?d|token|api[_-]?key)['\"]?\s*[:=]{1,2}\s*['\"`][^'\"`]*(?:change[_-]?me|placeholder|your[_ -]|x{3,}|todo|fixme|demo|sample|example)", ("placeholder-secret-value", WARNING, 0.7)),
    *_rules((), "code", r"(?i)\b\w*(?:secret|passw(?:or)?d|token|api[_-]?key|credentials?|auth)['\"]?\s*[:=]{1,2}\s*['\"`][^'\"`]*(?:change[_-]?me|placeholder|your[_ -]|x{3,}|todo|fixme|demo|sample|example|dummy|mock|test)", ("placeholder-secret-advanced", WARNING, 0.75)),
    # keys of well-known services
    *_rules((), "code", r"\bsk-(?:proj|svcacct)-\w+(?:-\w+)+", ("example-openai-key", ERROR, 0.8)),
    *_rules((), "code", r"\bsk-(?:proj|svcacct)-\w+(?:-\w+)+", ("example-openai-key-comprehensive", ERROR, 0.8), excludes=_OUTSIDE),
    *_rules((), "code", r"(?i)\bsk-(?:proj|svcacct)-\w[\w-]*example", ("example-api-key", ERROR, 0.95), ("example-openai-key-with-suffix", ERROR, 0.95)),
    *_rules((), "code", r"(?i)\b[ps]k_(?:live|test)_\w{20,}", ("example-stripe-key", ERROR, 0.9), ("example-stripe-key-comprehensive", ERROR, 0.9)),
    *_rules((), "code", r"\b[ps]k_test_\w{20,}", ("example-stripe-test-key", WARNING, 0.7)),
    *_rules((), "code", r"\bghp_[0-9A-Za-z]{36}\b", ("github-pat-general", ERROR, 0.8)),
    *_rules((), "code", r"(?i)\bghp_\w{4,}", ("example-github-token-comprehensive", ERROR, 0.85), excludes=_OUTSIDE),
    *_rules((), "code", r"(?i)\bghp_\w+example\b", ("example-github-pat", ERROR, 0.95), ("example-github-token-suffix", ERROR, 0.95)),
    *_rules((), "code", r"\bxox[a-z]-[\w-]{10,}", ("example-slack-token", ERROR, 0.85)),
    # secrets that fall back to a literal
    *_rules(JS, "code", r"(?i)\bprocess\.env\b[\w.\['\"\]]*(?:secret|token|key|pass|pwd|credential|auth)\w*['\"\]]*\s*\|\|\s*['\"`][^'\"`]{4,}", ("env-var-fallback-secret-js", ERROR, 0.85)),
    *_rules(JS, "code", r"(?i)\bprocess\.env\b[\w.\['\"\]]*(?:secret|token|key|pass|pwd|credential|auth)\w*['\"\]]*\s*\?\?\s*['\"`][^'\"`]{4,}", ("env-var-fallback-secret-nullish-js", ERROR, 0.85), ("env-var-fallback-secret-js-nullish", ERROR, 0.85)),
    *_rules(PY, "code", r"(?i)\b(?:environ\.get|getenv)\(\s*['\"]\w*(?:secret|token|key|pass|pwd|credential|auth)\w*['\"]\s*,\s*['\"][^'\"]{4,}", ("python-env-var-fallback-secret", ERROR, 0.85), ("env-var-fallback-secret-python", ERROR, 0.85)),
    # code made of text
    *_rules(JS, "code", r"\beval\s*\(", ("eval-usage-js", ERROR, 0.9)),
    *_rules(PY, "code", r"\beval\s*\(", ("eval-usage-python", ERROR, 0.9)),
    *_rules(PY, "code", r"\bexec\s*\(", ("exec-usage-python", ERROR, 0.85)),
    *_rules(JS, "code", r"\bnew\s+Function\b", ("new-function-js", WARNING, 0.85)),
    # statements and commands made of input
    *_rules(JS + JAVA + KT + PY, "code", r"(?i)\b(?:select|insert\s+into|update|delete\s+from|drop\s+table)\b.*['\"]\s*\+\s*\w*(?:req|param|query|body|input|user)", ("sql-string-concat", ERROR, 0.8)),
    *_rules(JS, "code", r"(?i)\b(?:select|insert\s+into|update|delete\s+from|drop\s+table)\b[^`]*\$\{[^}]*(?:req|param|query|body|input|user)", ("sql-template-literal", ERROR, 0.85)),
    *_rules(PY, "code", r"(?i)\bf['\"]+\s*(?:select|insert\s+into|update|delete\s+from|drop\s+table)\b.*\{[^}]*(?:req|param|query|body|input|user)", ("sql-f-string-python", ERROR, 0.85)),
    *_rules(JS, "code", r"\b(?:exec|spawn|execFile)(?:Sync)?\(\s*`[^`]*\$\{", ("shell-template-literal-injection", ERROR, 0.85)),
    *_rules(JS, "code", r"\bexec(?:Sync)?\([^)`]*(?:['\"]\s*\+\s*\w|\w\s*\+\s*['\"])", ("shell-string-concat-exec", ERROR, 0.8)),
    *_rules(PY, "code", r"\b(?:os\.(?:system|popen)|subprocess\.\w+)\(\s*[fF][rR]?['\"]", ("python-shell-f-string", ERROR, 0.85)),
    *_rules(PY, "code", r"\b(?:os\.(?:system|popen)|subprocess\.\w+)\(\s*['\"].*['\"]\.format\(", ("python-shell-format-string", ERROR, 0.85)),
    *_rules(JS, "code", r"(?i)\bJSON\.(?:parse|stringify)\(\s*\w*(?:req|body|params|query|input|user|event)", ("unsafe-json-parse-user-input", WARNING, 0.5)),
    *_rules(JS, "code", r"(?i)\bJSON\.(?:parse|stringify)\(\s*\w*(?:req|body|params|query|input|user|event|data)", ("unsafe-json-parse-enhanced", WARNING, 0.6), excludes=(r"(?i)schema|valid|safeparse",)),
    # weak or disabled protection
    *_rules((), "code", r"(?i)\bmd5\b", ("weak-hash-md5", WARNING, 0.75)),
    *_rules((), "code", r"(?i)\bsha-?1\b", ("weak-hash-sha1", WARNING, 0.7)),
    *_rules(JS, "code", r"\bMath\.random\(", ("weak-random", WARNING, 0.7)),
    *_rules((), "code", r"(?i)\b(?:rejectUnauthorized['\"]?\s*[:=]\s*false|verify\s*=\s*False|InsecureSkipVerify\s*:\s*true|NODE_TLS_REJECT_UNAUTHORIZED\W+0)\b", ("tls-verify-disabled", ERROR, 0.9)),
    *_rules((), "code", r"(?i)Allow-Origin['\"]?\s*[,:=]\s*['\"]\*|\bcors\(\s*\)|\ballowedOrigins\(\s*['\"]\*", ("cors-wildcard", WARNING, 0.7)),
    *_rules((), "code", r"(?i)(?:Allow-Origin|\bcors\.origin)\b.*(?:\*|\$\{)", ("cors-wildcard-with-dynamic", ERROR, 0.9)),
    *_rules((), "code", r"(?i)Allow-Origin\b.*\b(?:req|request|headers)\b", ("dynamic-cors-origin-reflection", ERROR, 0.85)),
    *_rules((), "code", r"(?i)(?:Allow-?Origin|\bcors\.origin)\b.*\b(?:req|request|headers)\b", ("dynamic-cors-origin-reflection-enhanced", ERROR, 0.85)),
    *_rules((), "code", r"(?i)(?:Allow-?Origin|\bcors\.origin)\b['\"]?\s*[,:=(].*\borigin\b", ("dynamic-cors-origin-variable", WARNING, 0.6)),
    *_rules((), "code", r"['\"]http://(?!localhost\b|127\.|0\.0\.0\.0|\[::1\])", ("http-no-tls", INFO, 0.5)),
    *_rules((), "code", r"\bjwt\.(?:sign|verify)\([^,]+,\s*(?:''|\"\"|'.{1,2}'|\".{1,2}\")\s*[,)]", ("jwt-empty-secret", ERROR, 0.85)),
    *_rules((), "code", r"\bjwt\.(?:sign|verify)\([^,]+,\s*['\"]\w{8,}['\"]", ("jwt-hardcoded-secret", ERROR, 0.8)),
    *_rules((), "code", r"(?i)\bjwt\.sign\(.*\balgorithm['\"]?\s*:\s*['\"]?(?:none|[HRE]S\d{3})", ("jwt-insecure-algorithm", ERROR, 0.8)),
    *_rules((), "code", r"\bjwt\.(?:sign|verify)\([^,]+,(?!.*\balgorithm)", ("jwt-no-algorithm-specification", WARNING, 0.6)),
    *_rules(JS, "code", r"\bjwt\.decode\(", ("jwt-claims-injection", WARNING, 0.5)),
    # what leaks
    *_rules(JS, "code", r"(?i)\bconsole\.\w+\(.*(?:passw(?:or)?d|secret|token|api[_-]?key|credential|authorization|cookie|session)", ("sensitive-data-logging", WARNING, 0.65)),
    *_rules(JS, "code", r"(?i)\bconsole\.(?:log|info|warn|error|debug)\(.*(?:passw(?:or)?d|secret|token|api[_-]?key|credential|authorization|cookie|session|jwt|private[_-]?key)", ("javascript-sensitive-data-logging-comprehensive", WARNING, 0.65)),
    *_rules(PY, "code", r"(?i)\b(?:print|log(?:ger|ging)?\.\w+)\(.*(?:passw(?:or)?d|secret|token|api[_-]?key|credential|authorization)", ("python-sensitive-logging", WARNING, 0.6)),
    *_rules(PY, "code", r"(?i)\b(?:print|log(?:ger|ging)?\.\w+)\(.*(?:passw(?:or)?d|secret|token|api[_-]?key|credential|authorization|jwt|private[_-]?key)", ("python-sensitive-data-logging-comprehensive", WARNING, 0.6)),
    *_rules(JS, "code", r"\bres\b.*\.(?:json|send)\(.*\b(?:stack|stackTrace|trace)\b", ("error-stack-in-response", ERROR, 0.85)),
    *_rules(JS, "code", r"\bcatch\b.*\bres\b.*\.(?:json|send)\(\s*(?:e|err|error)\b", ("error-details-in-response", WARNING, 0.65)),
    *_rules(PY, "code", r"\b(?:return|jsonify|Response)\b.*\btraceback\.(?:format|print)_exc", ("python-traceback-in-response", ERROR, 0.8)),
    *_rules(JS, "code", r"\bimport\b.*['\"](?:crypto|child_process|fs|os)['\"]", ("ai-generated-import-insecure", INFO, 0.4)),
    # protection that a comment puts off
    *_rules((), "all", r"(?i)//.*\b(?:todo|fixme|hack|xxx)\b.*\b(?:auth|permission|rbac|acl|access[ -]?control|login)", ("todo-auth-bypass", ERROR, 0.85)),
    *_rules((), "all", r"(?i)//.*\b(?:todo|fixme|hack|xxx)\b.*(?:validat|saniti[sz]|escap|(?:check|verify)\W+input|input\W+check)", ("todo-validation-bypass", WARNING, 0.8)),
    *_rules((), "all", r"(?i)//.*\b(?:todo|fixme|hack|xxx)\b.*\b(?:encrypt|decrypt|hash|sign|tls\b|ssl\b|cert)", ("todo-encryption-bypass", ERROR, 0.8)),
    *_rules((), "all", r"(?i)//.*\b(?:todo|fixme|hack|xxx)\b.*(?:rate[ -]?limit|throttl|brute[ -]?force|\bddos\b|\bdos\b)", ("todo-rate-limit-bypass", WARNING, 0.75)),
    *_rules((), "all", r"(?i)//.*\b(?:todo|fixme|hack|xxx)\b.*(?:secur|protect|csrf|xss|injection|vulnerab)", ("todo-security-generic", WARNING, 0.75)),
    *_rules(PY, "all", r"(?i)#.*\b(?:todo|fixme|hack|xxx)\b.*\b(?:auth|permission|validat|saniti[sz]|encrypt|security|rate[ -]?limit)", ("python-todo-security", WARNING, 0.75)),
    *_rules(PY, "all", r"(?i)#.*\b(?:todo|fixme|hack|xxx)\b.*\b(?:auth|permission|validat|saniti[sz]|encrypt|security|rate[ -]?limit|access[ -]?control|rbac|csrf|xss|injection|vulnerab)", ("todo-security-bypass-python", WARNING, 0.75)),
    *_rules(PY, "all", r"(?i)#.*\b(?:todo|fixme|hack|xxx)\b.*\b(?:auth|permission|rbac|acl|access[ -]?control|login)", ("todo-auth-bypass-python", ERROR, 0.85)),
    *_rules((), "all", r"(?i)(?://|#|/\*).*\b(?:todo|fixme|hack|xxx)\b.*\b(?:add|create|fix|implement|set ?up|write|configure)\b.*(?:secur|auth|validat|encrypt|protect)", ("generic-security-todo", WARNING, 0.7)),
    *_rules((), "all", r"(?i)//\s*(?:by\s+)?(?:ai|llm|gpt|generated)\b.*(?:secur|auth|validat|protect|encrypt|token|passw|secret)", ("ai-generated-comment-security", WARNING, 0.6)),
]

LANGUAGE_RULES = [
    *_rules(GO, "code", r"['\"]io/ioutil['\"]", ("go-deprecated-ioutil", WARNING, 0.95)),
    *_rules(GO, "code", api_pattern("call", "ioutil.ReadFile"), ("go-ioutil-readfile", WARNING, 0.95)),
    *_rules(GO, "code", api_pattern("call", "ioutil.WriteFile"), ("go-ioutil-writefile", WARNING, 0.95)),
    *_rules(GO, "code", api_pattern("call", "ioutil.ReadAll"), ("go-ioutil-readall", WARNING, 0.95)),
    *_rules(GO, "code", api_pattern("call", "panic"), ("go-panic-in-library", WARNING, 0.7)),
    *_rules(GO, "code", r"^\s*defer\s+[\w.]+\(\)\s*$", ("go-empty-defer", INFO, 0.5)),
    *_rules(JAVA, "code", api_pattern("call", "System.out.println"), ("java-system-out-println", WARNING, 0.85)),
    *_rules(JAVA, "code", api_pattern("call", "System.err.println"), ("java-system-err-println", WARNING, 0.85)),
    *_rules(JAVA, "code", r"\b[a-z]\w*\.equals\(\s*\w+\s*\)", ("java-equals-without-null", INFO, 0.5)),
    *_rules(JAVA, "code", r"\bcatch\b[^{]*\{\s*\}", ("java-empty-catch", WARNING, 0.9)),
    *_rules(JAVA, "code", r"\bnew\s+\w*(?:List|Map|Set|Vector|Hashtable|Stack)\s*<\s*>", ("java-raw-type", INFO, 0.8)),
    *_rules(JAVA, "code", r"\bnew\s+Date\(\s*\)", ("java-deprecated-date", WARNING, 0.8)),
    *_rules(JAVA, "code", api_pattern("call", "Calendar.getInstance"), ("java-deprecated-calendar", WARNING, 0.8)),
    *_rules(JAVA, "code", r"\bfor\b.*\{.*\+=\s*\"", ("java-string-concatenation-loop", WARNING, 0.65)),
    *_rules(KT, "code", r"!!\s*\.", ("kotlin-bang-bang-chain", WARNING, 0.8)),
    *_rules(KT, "code", r"!![^!]+!!", ("kotlin-bang-bang-multiple", WARNING, 0.85)),
    *_rules(KT, "code", api_pattern("call", "println"), ("kotlin-bare-println", INFO, 0.7)),
    *_rules(KT, "code", r"\.apply\s*\{\s*\w+\s*=[^=;]+\}", ("kotlin-unnecessary-apply", INFO, 0.6)),
    *_rules(KT, "code", r"\bcatch\b[^{]*\{\s*\}", ("kotlin-empty-catch", WARNING, 0.9)),
    *_rules(PY, "code", r"^\s*except\s*:", ("python-bare-except", WARNING, 0.9)),
    *_rules(PY, "code", api_pattern("call", "eval"), ("python-eval-usage", ERROR, 0.9)),
    *_rules(PY, "code", api_pattern("call", "exec"), ("python-exec-usage", ERROR, 0.85)),
    *_rules(PY, "code", api_pattern("import", "urllib.parse.urlparse"), ("python-deprecated-urlparse", INFO, 0.5)),
    *_rules(PY, "code", r"\bdef\s+\w+\(.*=\s*(?:\[\s*\]|\{\s*\}|set\(\)|dict\(\)|list\(\))\s*[,)]", ("python-mutable-default-arg", WARNING, 0.85)),
    *_rules(PY, "code", r"^\s*global\s+\w", ("python-global-variable", INFO, 0.5)),
    *_rules(PY, "code", r"^\s*except\b[^\n]*:\s*\n\s*pass\b", ("python-pass-in-except", WARNING, 0.85), window=1),
    *_rules(PY, "code", api_pattern("call", "os.system"), ("python-os-system", WARNING, 0.75)),
    *_rules(PY, "code", r"\bpickle\s*\.\s*loads?\(", ("python-pickle-load", ERROR, 0.8)),
]

INCOMPLETE_RULES = [
    *_rules(JS, "all", r"(?i)\bthrow\s+new\s+\w*Error\(\s*['\"`].{0,20}(?:not (?:yet )?implemented|unimplemented|todo|fixme|stub|tbd)", ("throw-not-implemented", ERROR, 0.95)),
    *_rules(JS, "all", r"(?i)\bthrow\s+['\"`].{0,20}(?:not (?:yet )?implemented|unimplemented|todo|fixme|stub|tbd)", ("throw-not-implemented-bare", ERROR, 0.9)),
    *_rules(PY, "all", r"\braise\s+NotImplementedError\b", ("python-raise-not-implemented", ERROR, 0.9)),
    *_rules(JAVA + KT, "all", r"(?i)\bthrow\s+(?:new\s+)?\w*(?:UnsupportedOperation|NotImplemented|Runtime)\w*\(\s*\".{0,20}(?:not (?:yet )?implemented|unimplemented|todo|fixme|stub|tbd)", ("java-throw-unsupported", ERROR, 0.9)),
    *_rules(GO, "all", r"(?i)\bpanic\(\s*[\"`].{0,20}(?:not (?:yet )?implemented|unimplemented|todo|fixme|stub|tbd)", ("go-panic-not-implemented", ERROR, 0.9)),
    *_rules(PY, "all", r"^\s*(?:async\s+)?def\b[^\n]*:\s*\n\s*pass\s*$", ("python-pass-only", WARNING, 0.8), window=1),
    *_rules(PY, "all", r"^\s*(?:async\s+)?def\b[^\n]*:\s*\n\s*\.{3}\s*$", ("python-ellipsis-only", WARNING, 0.8), window=1),
    *_rules((), "all", r"^\s*(?:console\.\w+|print(?:ln)?)\([^()]*\);?\s*$", ("console-only-function", INFO, 0.6)),
    *_rules((), "all", r"\breturn\s+(?:null|nil|None|undefined)\b", ("return-null-with-todo", WARNING, 0.7)),
    *_rules(JS, "all", r"\breturn\s*\{\s*\}", ("return-empty-object-with-todo", WARNING, 0.65)),
    *_rules(JS, "all", r"\breturn\s*\[\s*\]", ("return-empty-array-with-todo", WARNING, 0.65)),
    *_rules(PY, "all", r"\breturn\s*(?:None\b|\[\]|\{\}|\(\))\s*$", ("python-return-none-with-todo", WARNING, 0.65)),
]

ASYNC_RULES = [
    *_rules(JS, "code", r"\.forEach\(\s*async\b", ("async-foreach", ERROR, 0.95)),
    *_rules(JS, "code", r"=\s*[\w.]+\.map\(\s*async\b", ("async-map-no-promise-all", WARNING, 0.8), excludes=(r"\bPromise\s*\.\s*all",), around=(2, 3)),
    *_rules(JS, "code", r"\bnew\s+Promise\b.{0,40}\(\s*async\b", ("promise-constructor-async", WARNING, 0.9)),
    *_rules(JS, "code", r"(?s)\A[^\n]*\bnew\s+Promise\([^\n]*=>.*?\bawait\b", ("promise-constructor-wrapping-await", WARNING, 0.75), window=5),
    *_rules(JS, "code", r"\A[^\n]*\.then\(", ("then-without-catch", WARNING, 0.6), excludes=(r"\.catch\b", r"\.finally\b", r"\bawait\b|\breturn\b"), around=(2, 3)),
    *_rules(JS, "code", r"^\s*(?:(?:void|this)\b[ .])?\w*(?:[aA]sync|[fF]etch)\w*\([^;]*\);?\s*$", ("fire-and-forget-async-call", WARNING, 0.5), excludes=(r"\bawait\b|\breturn\b|=>|\bfunction\b|\.then\b|\.catch\b|[=]",)),
    *_rules(JS, "code", r"\A[^\n]*=\s*await\b[^\n]*\n\s*(?:const|let|var)\b[^\n]*=\s*await\b", ("sequential-independent-awaits", INFO, 0.5), window=1),
    *_rules(JS, "code", r"(?s)\A[^\n]*\basync\b[^\n]*\{[^\n]*\n\s*return\b(?!\s+await\b)[^\n]*\n?\s*\}?", ("return-async-without-await", INFO, 0.4), excludes=(r"\bawait\b",), window=2, around=(0, 3)),
    *_rules(PY, "code", r"\b(?:time\.sleep|requests\.\w+|urllib\.request\.urlopen)\(", ("python-sync-in-async", WARNING, 0.6)),
    *_rules(PY, "code", api_pattern("call", "asyncio.run"), ("python-asyncio-run-in-async", WARNING, 0.7)),
    *_rules(GO, "code", r"\bgo\s+func\b", ("go-goroutine-no-error-handling", INFO, 0.5), excludes=(r"\berrgroup\b|\bWaitGroup\b|\bchan\b|<-|\brecover\(",), around=(2, 3)),
]

BOT_RULES = [
    *_rules((), "all", r"\b(?:fs\.readFileAsync|Promise\.allResolved|Array\.flatDeep|Object\.deepClone|String\.format|Array\.contains|Object\.merge)\b", ("suspicious-api", WARNING, 0.7)),
    # Package names that are commonly made up.
    *_rules((), "all", r"['\"](?:react-native-vector-icons/Ionicons|@google/generative-ai-node|openai-edge|langchain/core|firebase-admin/firestore|@tensorflow/tfjs-node-gpu|mongoose-auto-increment|express-async-handler)['\"]", ("suspicious-package", WARNING, 0.7)),
    *_rules((), "all", r"\b(?:import|from|require)\b[\s(]*['\"]@?[\w.-]+(?:/[\w.-]+){4,}['\"]", ("deep-import-path", INFO, 0.5)),
    *_rules((), "all", r"\bcatch\b[^{]*\{\s*\}", ("empty-catch", ERROR, 0.9)),
    *_rules((), "all", r"\A[^\n]*\bcatch\b[^{\n]*\{\s*\n\s*//[^\n]*\n\s*\}", ("comment-only-catch", WARNING, 0.8), window=2),
    *_rules((), "all", r"//.*\b(?:TODO|FIXME|HACK|XXX)\b", ("unresolved-marker", WARNING, 0.8)),
    *_rules((), "all", r"\bconsole\.(?:log|info|debug)\(", ("console-left", INFO, 0.6)),
    *_rules((), "all", r"\A\s*return\b[^\n]*;\s*\n\s*[^\s}/]", ("unreachable-after-return", WARNING, 0.6), window=1),
]

V4_CATALOG = {
    "stale-api": STALE_RULES, "security-pattern": SECURITY_RULES, "language-specific": LANGUAGE_RULES,
    "incomplete-implementation": INCOMPLETE_RULES, "async-antipattern": ASYNC_RULES,
}
CATEGORY = {"stale-api": "code-freshness", "security-pattern": "implementation", "language-specific": "implementation", "incomplete-implementation": "implementation", "async-antipattern": "implementation"}
