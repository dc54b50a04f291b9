"""Rules over source lines: a catalogue by family, the engine that finds them, and audit scores.

A rule has a scope. ``line``: its pattern holds for a line and ``unless`` doesn't hold for the same line; line
comments are cut first unless the rule is about them. ``file``: the pattern holds for a line, and ``unless`` for no
line of the file; the finding is at the first such line. ``loop``: as ``line``, but only within the body of a loop.
``squeezed``: the pattern holds for the text without comments and white space, which has no lines.

Patterns use no look-around, so that any engine reads them alike. They are literals in the plan, compiled once in a
task; a file is split into lines in the JVM and yields a row for each finding.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named pattern with its severity, family and scope; ``code``: line comments are no part of the line."""

    name: str
    pattern: str
    severity: str = "medium"
    unless: str | None = None
    family: str = "common"
    scope: str = "line"
    code: bool = True


def _family(family: str, *rules: tuple) -> list[Rule]:
    return [Rule(n, p, s, *(more[:1] or (None,)), family=family, scope=(more[1] if len(more) > 1 else "line")) for n, p, s, *more in rules]


#: Rules by family: (name, pattern, severity, unless, scope).
CATALOGUE = [
    Rule("scaffolding", r"(?i)(//|#)\s*(todo|fixme|hack|xxx)\b", "low", code=False),
    *_family(
        "common",
        ("empty-catch", r"\bcatch(\([A-Za-z_$][A-Za-z0-9_$:]*\))?\{\}", "high", None, "squeezed"),
        ("any-type", r":\s*any\b|\bas\s+any\b", "low"),
        ("console-log", r"\bconsole\.(log|debug|info)\s*\(", "low"),
        ("await-in-loop", r"\bawait\b", "medium", r"\bfor\s+await\b", "loop"),
        ("toctou", r"\b(existsSync|findFirst|findUnique|is_file|file_exists)\s*\(", "low"),
    ),
    *_family(
        "perf",
        ("unbounded-query", r"\b(findMany|findAll|selectAll)\s*\(\s*(\{\s*\})?\s*\)", "high", r"\b(take|limit|first)\b"),
        ("unbounded-findmany", r"\bfindMany\s*\(", "medium", r"\b(take|limit)\b"),
        ("sync-in-handler", r"\b(readFileSync|writeFileSync|execSync|spawnSync|readdirSync)\s*\(", "high"),
        ("unbounded-parallel", r"\bPromise\.all\s*\([^)]*\.map\s*\(", "medium", r"(?i)limit|chunk|batch"),
        ("missing-pagination", r"(?i)\bselect\s+\*\s+from\s+\w+\s*[;\"'`]", "medium", r"(?i)\b(limit|where|offset)\b"),
        ("n-plus-one", r"\b(findOne|findUnique|findFirst|fetchOne|query|select)\s*\(", "high", None, "loop"),
        ("expensive-recompute", r"\b(JSON\.parse|JSON\.stringify|new\s+RegExp|structuredClone|re\.compile)\s*\(", "medium", None, "loop"),
    ),
    *_family(
        "database",
        ("unsafe-raw-sql", r"\$(queryRawUnsafe|executeRawUnsafe)\b|(?i:select|insert|update|delete)\s[^;]*\$\{", "high"),
        ("migration-drop-column", r"(?i)\bdrop\s+column\b", "high"),
        ("migration-alter-column-type", r"(?i)\balter\s+column\s+\S+\s+(set\s+data\s+)?type\b", "medium"),
        ("migration-not-null-no-default", r"(?i)\badd\s+column\b.*\bnot\s+null\b", "high", r"(?i)\bdefault\b"),
        ("migration-create-index-no-concurrently", r"(?i)\bcreate\s+(unique\s+)?index\b", "medium", r"(?i)\bconcurrently\b"),
    ),
    *_family(
        "python",
        ("mutable-default", r"\bdef\s+\w+\s*\(.*=\s*(\[\]|\{\}|list\(\)|dict\(\)|set\(\))", "medium"),
        ("bare-except", r"^\s*except\s*:", "high"),
        ("broad-except", r"^\s*except\s+(Base)?Exception\b", "medium"),
        ("global-keyword", r"^\s+global\s+\w", "low"),
        ("star-import", r"^\s*from\s+\S+\s+import\s+\*", "low"),
        ("print-debug-py", r"^\s*print\s*\(", "low"),
        ("eval-exec", r"\b(eval|exec)\s*\(", "high"),
        ("shell-true", r"\bshell\s*=\s*True\b", "high"),
        ("pickle-load", r"\bpickle\.loads?\s*\(", "high"),
        ("yaml-unsafe", r"\byaml\.load\s*\(", "high", r"SafeLoader|safe_load"),
        ("open-no-with", r"^\s*\w+\s*=\s*open\s*\(", "low"),
        ("datetime-naive", r"\bdatetime\.(now|utcnow)\s*\(\s*\)", "low"),
        ("assert-tuple", r"^\s*assert\s*\(.+,.+\)\s*$", "medium"),
        ("shadow-builtin", r"^\s*(list|dict|set|str|int|id|type|input|filter|map|sum|min|max|len)\s*=[^=]", "low"),
        ("string-concat-loop", r"^\s*\w+\s*\+=\s*(f?[\"']|str\()", "low", None, "loop"),
        ("n-plus-one-django", r"\.(objects\.get|objects\.filter|\w+_set\.all)\s*\(", "high", None, "loop"),
        ("late-binding", r"\blambda\s*:", "low", None, "loop"),
    ),
    *_family(
        "async",
        ("blocking-sleep", r"^\s*time\.sleep\s*\(", "high", r"\basyncio\b"),
        ("blocking-requests", r"\brequests\.(get|post|put|patch|delete|head)\s*\(", "high"),
        ("blocking-subprocess", r"\bsubprocess\.(run|call|check_call|check_output)\s*\(", "medium"),
        ("blocking-io", r"^\s*(with\s+)?open\s*\(", "low", r"\baiofiles\b"),
        ("sync-db-in-async", r"\b(psycopg2|pymysql|sqlite3)\.connect\s*\(", "medium"),
        ("sync-orm-django", r"\.objects\.(get|all|filter|create)\s*\(", "medium", r"\b(sync_to_async|aget|acreate)\b"),
        ("globalscope-task", r"^\s*asyncio\.(create_task|ensure_future)\s*\(", "medium"),
        ("async-without-await", r"^\s*async\s+def\s+\w+", "low", r"\b(await|async\s+(with|for)|yield)\b", "file"),
    ),
    *_family(
        "django",
        ("debug-enabled", r"^DEBUG\s*=\s*True\b", "critical"),
        ("empty-allowed-hosts", r"^ALLOWED_HOSTS\s*=\s*\[\s*\]", "high"),
        ("wildcard-allowed-hosts", r"^ALLOWED_HOSTS\s*=\s*\[.*[\"']\*[\"']", "high"),
        ("hardcoded-secret-key", r"^SECRET_KEY\s*=\s*[\"']", "critical", r"environ|getenv|config\("),
        ("weak-secret-key", r"^SECRET_KEY\s*=\s*[\"'](.{0,19}|django-insecure.*)[\"']\s*$", "high"),
        ("insecure-cookie", r"^(SESSION|CSRF)_COOKIE_SECURE\s*=\s*False\b", "high"),
        ("cors-wildcard", r"^CORS_(ORIGIN_ALLOW_ALL|ALLOW_ALL_ORIGINS)\s*=\s*True\b", "high"),
        ("default-db-password", r"[\"']PASSWORD[\"']\s*:\s*[\"'](postgres|password|root|admin|)[\"']", "high"),
        ("sqlite-in-prod", r"[\"']ENGINE[\"']\s*:\s*[\"']django\.db\.backends\.sqlite3[\"']", "medium"),
        ("email-backend-console", r"^EMAIL_BACKEND\s*=.*console", "low"),
        ("logging-disabled", r"^LOGGING_CONFIG\s*=\s*None\b", "medium"),
        ("missing-csrf-middleware", r"^MIDDLEWARE\s*=", "high", r"CsrfViewMiddleware", "file"),
        ("missing-security-middleware", r"^MIDDLEWARE\s*=", "medium", r"SecurityMiddleware", "file"),
        ("xframe-missing", r"^MIDDLEWARE\s*=", "low", r"XFrameOptionsMiddleware", "file"),
        ("missing-hsts", r"^MIDDLEWARE\s*=", "low", r"SECURE_HSTS_SECONDS", "file"),
    ),
    *_family(
        "php",
        ("sql-injection-php", r"(?i)(mysqli?_query|->query)\s*\([^)]*\$_(get|post|request)", "critical"),
        ("xss-php", r"(?i)\becho\s+[^;]*\$_(get|post|request)", "critical", r"htmlspecialchars|htmlentities"),
        ("eval-php", r"\beval\s*\(\s*\$", "critical"),
        ("exec-php", r"\b(shell_exec|passthru|system|proc_open)\s*\(", "high"),
        ("unserialize-php", r"\bunserialize\s*\(", "high"),
        ("file-include-var", r"\b(include|require)(_once)?\s*\(?\s*\$", "high"),
        ("php-md5-password", r"(?i)\bmd5\s*\(\s*\$\w*pass", "high"),
        ("php-rand-token", r"(?i)\$\w*token\w*\s*=[^;]*\b(mt_rand|rand|uniqid)\s*\(", "high"),
        ("php-loose-comparison-secret", r"(?i)\$\w*(token|secret|hash|password)\w*\s*==\s*[^=]", "high"),
    ),
    *_family(
        "php8",
        ("each-removed", r"\beach\s*\(\s*\$", "high", r"\bforeach\b"),
        ("create-function-removed", r"\bcreate_function\s*\(", "high"),
        ("money-format-removed", r"\bmoney_format\s*\(", "high"),
        ("real-cast-removed", r"\(real\)\s*\$|\bis_real\s*\(", "high"),
        ("utf8-encode-decode", r"\butf8_(en|de)code\s*\(", "medium"),
        ("ambiguous-ternary", r"\?[^?:;]+:[^?:;()]+\?[^?:;]+:", "high"),
        ("concatenation-precedence", r"\"\s*\.\s*\$\w+\s*[+-]\s*\$?\w+", "medium"),
        ("array-key-exists-on-object", r"\barray_key_exists\s*\([^,]+,\s*\$this\b", "high"),
        ("dynamic-property-creation", r"\$this->\{\s*\$", "medium"),
        ("core-fn-null-string-arg", r"\b(strlen|trim|strpos|str_replace|htmlspecialchars)\s*\(\s*null\b", "medium"),
        ("is-resource-on-closed", r"\bis_resource\s*\(\s*\$\w*(curl|gd|img|socket)", "low"),
        ("spread-operator-on-string-keys", r"\[\s*\.\.\.\s*\$\w+", "low"),
    ),
    *_family(
        "php8-migration",
        ("match-from-switch", r"\bswitch\s*\(", "low"),
        ("enum-from-class-consts", r"^\s*(public\s+)?const\s+[A-Z_]+\s*=\s*[\"'0-9]", "low"),
        ("docblock-to-typed-property", r"^\s*\*\s*@var\s+\??(int|string|bool|float|array)\b", "low"),
        ("nullable-flag-to-syntax", r"\b(int|string|bool|float|array)\s+\$\w+\s*=\s*null\b", "low", r"\?(int|string|bool|float|array)\s+\$"),
        ("promotable-ctor", r"^\s*\$this->\w+\s*=\s*\$\w+;", "low"),
        ("readonly-candidate", r"^\s*private\s+(int|string|bool|float|array|[A-Z]\w*)\s+\$\w+;", "low"),
    ),
    *_family(
        "yii",
        ("unescaped-yii-view", r"<\?=\s*\$\w+->\w+", "high", r"Html::encode|HtmlPurifier"),
        ("raw-query-yii", r"createCommand\s*\([^)]*(\$\w+|\.\s*\$)", "high", r"bindValue"),
        ("yii-csrf-disabled", r"enableCsrfValidation[\"']?\s*(=>|=)\s*false\b", "high"),
        ("yii-debug-mode-prod", r"define\s*\(\s*[\"']YII_DEBUG[\"']\s*,\s*true", "high"),
        ("yii-cookie-no-validation", r"cookieValidationKey[\"']?\s*=>\s*([\"'][\"']|false)", "high"),
        ("yii-mass-assignment-unsafe", r"->setAttributes\s*\([^)]*,\s*false\s*\)", "high"),
        ("yii-raw-sql-where", r"->(and|or)?[wW]here\s*\(\s*[\"'][^\"']*[\"']\s*\.", "high"),
        ("yii-unbounded-all", r"::find\(\)->all\s*\(\s*\)", "medium"),
        ("yii-cache-no-ttl", r"->cache->set\s*\([^,()]+,[^,()]+\)", "low"),
        ("yii-config-hardcoded-secret", r"[\"'](password|secret|apiKey)[\"']\s*=>\s*[\"'][^\"']{6,}[\"']", "high", r"getenv|env\("),
        ("yii-translate-in-loop", r"\bYii::t\s*\(", "low", None, "loop"),
        ("yii-no-row-level-locking", r"->beginTransaction\s*\(", "low", r"(?i)for\s+update", "file"),
        ("yii-dbtarget-info-level", r"DbTarget.*[\"'](info|trace)[\"']", "low"),
        ("behaviors-to-attributes", r"function\s+behaviors\s*\(", "low"),
        ("rules-to-attributes", r"function\s+rules\s*\(", "low"),
        ("urlmanager-rule-to-route", r"[\"']urlManager[\"']\s*=>", "low"),
    ),
    *_family(
        "react",
        ("dangerously-set-html", r"\bdangerouslySetInnerHTML\b", "high"),
        ("index-as-key", r"\bkey=\{\s*(index|idx|i)\s*\}", "low"),
        ("inline-handler", r"\bon[A-Z]\w*=\{\s*\(?[\w,\s]*\)?\s*=>", "low"),
        ("useEffect-async", r"\buseEffect\s*\(\s*async\b", "medium"),
        ("useEffect-object-dep", r"\}\s*,\s*\[[^\]]*[\[{]", "medium"),
        ("usecallback-no-deps", r"\b(useCallback|useMemo)\s*\(\s*\(?\w*\)?\s*=>[^,]*\)\s*;?\s*$", "low"),
        ("hook-usestate-destructure", r"\b(const|let)\s+\w+\s*=\s*useState\s*\(", "low"),
        ("direct-dom-access", r"\bdocument\.(getElementById|querySelector(All)?)\s*\(", "medium"),
        ("unstable-default-value", r"\(\s*\{[^}]*=\s*(\[\]|\{\})", "low"),
        ("jsx-falsy-and", r"\{\s*\w+\.length\s*&&", "low"),
        ("prefer-function-component", r"\bclass\s+\w+\s+extends\s+(React\.)?(Pure)?Component\b", "low"),
        ("context-provider-value-inline", r"\.Provider\s+value=\{\s*[\[{]", "medium"),
        ("stale-closure-setstate", r"\bset([A-Z]\w*)\s*\(\s*[a-z]\w*\s*[+-]\s*\d", "medium"),
        ("jsx-no-target-blank", r"target=[\"']_blank[\"']", "medium", r"rel=[\"'][^\"']*noopener"),
        ("button-no-type", r"<button\b", "low", r"\btype="),
        ("useEffect-missing-cleanup", r"\b(addEventListener|setInterval|subscribe)\s*\(", "medium", r"\b(removeEventListener|clearInterval|unsubscribe)\b", "file"),
        ("tanstack-missing-invalidation", r"\buseMutation\s*\(", "medium", r"\binvalidateQueries\b", "file"),
        ("missing-display-name", r"\b(React\.)?(memo|forwardRef)\s*\(", "low", r"\bdisplayName\b", "file"),
        ("react19-use-without-suspense", r"=\s*use\s*\(", "medium", r"\bSuspense\b", "file"),
        ("react19-form-action-non-function", r"<form\b[^>]*\baction=[\"']", "low"),
        ("react19-useoptimistic-no-transition", r"\buseOptimistic\s*\(", "low", r"\b(useTransition|startTransition)\b", "file"),
        ("compiler-prop-mutation", r"\bprops\.\w+(\.\w+)*\s*=[^=]|\bprops\.\w+\.(push|splice|sort)\s*\(", "high"),
        ("compiler-ref-read-in-render", r"\breturn\b.*\bref\.current\b", "medium"),
        ("compiler-redundant-memo", r"\bReact\.memo\s*\(", "low"),
        ("compiler-redundant-usecallback", r"\buseCallback\s*\(", "low"),
        ("rsc-date-prop", r"=\{\s*new\s+Date\s*\(", "low"),
    ),
    *_family(
        "nextjs",
        ("nextjs-wrong-router", r"from\s+[\"']next/router[\"']", "medium"),
        ("nextjs-revalidatetag-deprecated", r"\brevalidateTag\s*\([^,()]*\)", "medium"),
        ("nextjs-use-cache-without-tag", r"^\s*[\"']use cache[\"']", "low", r"\bcacheTag\s*\(", "file"),
        ("nextjs-missing-use-client", r"\b(useState|useEffect|useReducer|useRef)\s*\(", "high", r"^\s*[\"']use client[\"']", "file"),
        ("nextjs-unnecessary-use-client", r"^\s*[\"']use client[\"']", "low", r"\buse[A-Z]\w*\s*\(|\bon[A-Z]\w*=|\b(window|document|localStorage)\.", "file"),
        ("nextjs-fetch-waterfall", r"=\s*await\s+fetch\s*\(", "low", r"\bPromise\.all\b", "file"),
    ),
    *_family(
        "nest",
        ("nest-circular-inject", r"\bforwardRef\s*\(\s*\(\s*\)\s*=>", "medium"),
        ("nest-catch-all-filter", r"@Catch\s*\(\s*\)", "medium"),
        ("nest-request-scope", r"\bScope\.REQUEST\b", "medium"),
        ("nest-raw-exception", r"\bthrow\s+new\s+Error\s*\(", "low"),
        ("nest-any-guard-return", r"\bcanActivate\b.*\breturn\s+true\b", "high"),
        ("nest-service-locator", r"\bmoduleRef\.(get|resolve)\s*\(", "medium"),
        ("nest-direct-env", r"\bprocess\.env\.\w+", "low"),
        ("nest-eager-relation", r"\beager\s*:\s*true\b", "medium"),
        ("nest-typeorm-synchronize-prod", r"\bsynchronize\s*:\s*true\b", "high"),
        ("nest-exposed-stack-trace", r"\b(json|send)\s*\([^)]*\.stack\b", "high"),
        ("nest-cors-wildcard", r"(?i)\borigin\s*:\s*[\"']\*[\"']", "high"),
        ("nest-disabled-csrf", r"(?i)\bcsrf\s*:\s*false\b", "high"),
        ("nest-sync-fs-in-handler", r"\bfs\.\w+Sync\s*\(", "medium"),
        ("nest-param-decorator-no-type", r"@(Param|Query|Body)\s*\([^)]*\)\s*\w+\s*[,)]", "low"),
        ("nest-graphql-no-auth", r"@(Query|Mutation)\s*\(", "high", r"@UseGuards", "file"),
        ("nest-missing-guard-method", r"\bimplements\b.*\bCan(Activate|Load)\b", "high", r"\bcan(Activate|Load)\s*\(", "file"),
        ("nest-missing-pipe-transform", r"\bimplements\b.*\bPipeTransform\b", "high", r"\btransform\s*\(", "file"),
        ("nest-missing-filter-catch", r"\bimplements\b.*\bExceptionFilter\b", "high", r"\bcatch\s*\(", "file"),
        ("nest-missing-interceptor-intercept", r"\bimplements\b.*\bNestInterceptor\b", "high", r"\bintercept\s*\(", "file"),
        ("nest-require-primary-key", r"@Entity\s*\(", "high", r"@Primary(Generated)?Column", "file"),
        ("nest-orm-in-controller", r"@InjectRepository\s*\(", "medium", r"@Injectable\b", "file"),
    ),
    *_family(
        "hono",
        ("hono-missing-error-handler", r"\bnew\s+Hono\b", "medium", r"\.onError\s*\(", "file"),
        ("hono-throw-raw-error", r"\bthrow\s+new\s+Error\s*\(", "medium"),
        ("hono-missing-validator", r"\bc\.req\.(json|parseBody)\s*\(", "medium", r"\b(zValidator|validator)\s*\(", "file"),
        ("hono-unguarded-json-parse", r"\bc\.req\.json\s*\(\s*\)", "low", r"\btry\b", "file"),
        ("hono-env-type-any", r"\bnew\s+Hono\s*\(", "low"),
        ("hono-missing-status-code", r"\bc\.json\s*\(\s*\{[^}]*\}\s*\)", "low"),
        ("hono-full-app-rpc-export", r"\bexport\s+type\s+\w+\s*=\s*typeof\s+app\b", "medium"),
        ("missing-rate-limit", r"\.(post|put)\s*\(\s*[\"']/(login|auth|signup|register)", "medium", r"(?i)rate.?limit", "file"),
        ("missing-auth", r"\.(post|put|patch|delete)\s*\(\s*[\"']/", "high", r"(?i)(jwt|bearer|basic)auth|requireAuth|auth\w*\s*\(", "file"),
        ("missing-secure-headers", r"\bnew\s+Hono\b", "low", r"\bsecureHeaders\s*\(", "file"),
        ("env-regression", r"\bprocess\.env\.\w+", "low"),
    ),
    *_family(
        "astro",
        ("astro-glob-usage", r"\bAstro\.glob\s*\(", "high"),
        ("astro-set-html-xss", r"\bset:html=\{", "high"),
        ("astro-img-element", r"<img\b", "low"),
        ("astro-no-image-dimensions", r"<Image\b[^>]*>", "medium", r"\bwidth="),
        ("astro-inline-script-no-is-inline", r"<script\b", "low", r"\bis:inline\b|\bsrc="),
        ("astro-env-secret-in-client", r"\bimport\.meta\.env\.SECRET_", "high"),
        ("astro-hardcoded-site-url", r"href=[\"']https?://(localhost|127\.0\.0\.1)", "low"),
        ("astro-missing-lang-attr", r"<html\b", "medium", r"\blang="),
        ("astro-form-without-action", r"<form\b", "low", r"\baction="),
        ("astro-view-transitions-deprecated", r"\bViewTransitions\b", "high"),
        ("astro-client-on-astro", r"<[A-Z]\w*Astro\b[^>]*\bclient:", "high"),
        ("astro-hydration-load", r"\bclient:load\b", "medium"),
        ("astro-hydration-only-no-framework", r"\bclient:only(\s|>|/)", "high"),
        ("astro-missing-getStaticPaths", r"\bAstro\.params\b", "medium", r"\bgetStaticPaths\b|\bprerender\s*=\s*false", "file"),
        ("astro-legacy-content-collections", r"\bdefineCollection\s*\(\s*\{\s*type\s*:", "high"),
        ("astro-action-without-input", r"\bdefineAction\s*\(", "medium", r"\binput\s*:", "file"),
        ("astro-session-without-driver", r"\bAstro\.session\b|\bcontext\.session\b", "low", r"\bdriver\s*:", "file"),
        ("astro-env-undeclared", r"\bastro:env/(server|client)\b", "low", r"\benvField\.", "file"),
        ("astro-db-raw-sql", r"\bsql`[^`]*\$\{", "high"),
        ("astro-db-delete-without-where", r"\bdb\.delete\s*\([^)]*\)\s*;", "high"),
        ("astro-db-column-no-type", r"\bcolumn\.\w+\s*\(\s*\)", "low"),
        ("astro-img-without-alt", r"<(img|Image)\b[^>]*>", "medium", r"\balt="),
        ("astro-svg-inline-import", r"\bimport\s+\w+\s+from\s+[\"'][^\"']+\.svg\?raw[\"']", "low"),
    ),
    *_family(
        "kotlin",
        ("runblocking-in-coroutine", r"\brunBlocking\s*[({]", "medium"),
        ("globalscope-launch", r"\bGlobalScope\.(launch|async)\b", "high"),
        ("data-class-mutable", r"\bdata\s+class\s+\w+\s*\([^)]*\bvar\s", "medium"),
        ("lateinit-no-check", r"\blateinit\s+var\b", "low", r"\bisInitialized\b", "file"),
        ("empty-when-branch", r"->\s*\{\s*\}", "low"),
        ("mutable-shared-state", r"^\s*(companion\s+)?object\b.*\bvar\s", "medium"),
        ("kotest-missing-assertion", r"\b(test|it|should)\s*\(\s*\"", "medium", r"\b(shouldBe|shouldThrow|assert\w*)\b", "file"),
        ("compose-missing-remember", r"\b(mutableStateOf|derivedStateOf)\s*[({]", "high", r"\bremember"),
        ("compose-unstable-lambda", r"\bon[A-Z]\w*\s*:\s*\([^)]*\)\s*->\s*Unit", "low"),
        ("compose-side-effect-in-composition", r"\b(scope|coroutineScope)\.launch\s*\{", "medium", r"\bLaunchedEffect\b|\bonClick\b"),
    ),
    *_family(
        "html",
        ("inline-script", r"(?i)<script>", "medium", r"(?i)<script>\s*</script>"),
        ("inline-style", r"(?i)<style[ >]", "low"),
        ("unescaped-entity", r"&[^a-zA-Z#]", "low"),
        ("img-without-alt", r"(?i)<img\b[^>]*>", "medium", r"(?i)\balt="),
    ),
]

#: Credential shapes.
SECRETS = [
    Rule("token-assignment", r"(?i)\b(token|secret|api[_-]?key|passw(or)?d)\s*[:=]\s*[\"'][A-Za-z0-9+/_=.-]{16,}[\"']", "high", family="secret", code=False),
    Rule("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b", "critical", family="secret", code=False),
    Rule("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "critical", family="secret", code=False),
    Rule("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", "critical", family="secret", code=False),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "high", family="secret", code=False),
    Rule("hex-secret", r"\b[0-9a-f]{40}\b", "medium", family="secret", code=False),
]


#: A header of a loop with its own block.
LOOP = r"\b(for|foreach|while)\s*\(|\.(forEach|map|each)\s*\("
_SEVERITY_COST = {"critical": 20, "high": 10, "medium": 4, "low": 1}


def needed(pattern: str, every: bool = False) -> list[str] | list[list[str]] | None:
    """Literals of which every match of the pattern holds one: the choice whose shortest literal is longest; None without such.

    ``every``: all such choices, single characters among them; a match holds one literal of each.
    Read off the parsed pattern: runs of letters outside optional parts, and alternatives that all have one.
    """

    def choices(items) -> list[list[str]]:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is parser.LITERAL:
                run += chr(arg)
                continue
            if op is parser.SUBPATTERN and not arg[1]:
                inner = choices(arg[3])
            elif op is parser.MAX_REPEAT and arg[0] >= 1:
                inner = choices(arg[2])
            elif op is parser.BRANCH:
                each = [best(choices(b)) for b in arg[1]]
                # what precedes the alternatives belongs to each of them, if it begins the alternative
                starts = [all(b and b[0][0] is parser.LITERAL for b in arg[1])]
                inner = [[x for e in each for x in e]] if all(each) and not starts[0] else []
                if starts[0]:
                    heads = []
                    for b in arg[1]:
                        head = ""
                        for o, a in b:
                            if o is not parser.LITERAL:
                                break
                            head += chr(a)
                        heads.append(run + head)
                    inner = [heads]
            else:
                inner = []
            if run:
                found.append([run])
            run = ""
            found += inner
        return found

    def best(found: list[list[str]]) -> list[str] | None:
        return max(found, key=lambda f: min(map(len, f)), default=None)

    parsed = parser.parse(pattern)
    fold = bool(parsed.state.flags & re.IGNORECASE)
    found = choices(parsed)
    if every:
        return [[x.lower() if fold else x for x in f] for f in found if len(f) <= 8 and all(f)]
    literals = best(found)
    if not literals or min(map(len, literals)) < 2 or len(literals) > 8:
        return None
    return [x.lower() for x in literals] if fold else literals


#: Signs by which rules are grouped, rarest in prose first: a line without the sign isn't asked for the group's rules.
SIGNS = "$`{}@[]<>&=(?\"'#/_:;)"


def sign_of(pattern: str) -> str | None:
    """The first of ``SIGNS`` that every match of the pattern holds."""
    held = [f[0] for f in needed(pattern, every=True) if len(f) == 1]
    return next((c for c in SIGNS if any(c in x for x in held)), None)


def _may_match(on: Column, low: Column, pattern: str) -> Column | None:
    """Whether all literals are there that a match holds, short ones too; None if the pattern tells of none."""
    place = low if re.compile(pattern).flags & re.IGNORECASE else on
    out = None
    for literals in sorted(needed(pattern, every=True), key=lambda f: (len(f), -min(map(len, f)))):
        some = None
        for x in literals:
            one = F.contains(place, F.lit(x))
            some = one if some is None else some | one
        out = some if out is None else out & some
    return out


def _matches(on: Column, low: Column, pattern: str) -> Column:
    """``rlike``, asked only where the literals that every match holds are there."""
    may = _may_match(on, low, pattern)
    return on.rlike(pattern) if may is None else may & on.rlike(pattern)


def without_comments(line: Column) -> Column:
    """The line up to a ``//`` that no colon precedes; nothing of a line that is a ``#`` or ``*`` comment."""
    has = lambda c: F.contains(line, F.lit(c))
    cut = F.regexp_replace(F.regexp_replace(line, r"(^|[^:])//.*$", "$1"), r"^\s*(#|\*).*$", "")
    return F.when(has("//") | has("#") | has("*"), cut).otherwise(line)


def source_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line_no, line)`` of every line, from 1; a null text has none."""
    return df.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def _line_findings(line: Column, bare: Column, low_line: Column, low_bare: Column, rules: list[Rule]) -> Column:
    """Array of structs (rule, severity, family) of the rules that hold for the line."""
    groups: dict[tuple[bool, str | None], list[Column]] = {}
    for r in rules:
        on, low = (bare, low_bare) if r.code else (line, low_line)
        match = _matches(on, low, r.pattern)
        if r.unless and r.scope != "file":
            match = match & ~on.rlike(r.unless)
        hit = F.when(match, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.family).alias("family")))
        groups.setdefault((r.code, sign_of(r.pattern)), []).append(hit)
    none = F.array().cast("array<struct<rule:string,severity:string,family:string>>")
    found = []
    for (code, sign), hits in groups.items():
        there = F.lit(True) if sign is None else F.contains(bare if code else line, F.lit(sign))
        found.append(F.when(there, F.array_compact(F.array(*hits))).otherwise(none))
    return F.concat(*found)


def scan(df: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """``(key, rule, severity, family, line_no, context)`` of every finding; ``line_no`` is null for the squeezed scope.

    ``context``: the line without outer white space, 200 characters at most.
    """
    own = [r for r in rules if r.scope == "line"]
    parts = []
    lines = source_lines(df, key, text).withColumn("bare", without_comments(F.col("line")))
    lows = lambda d: d.withColumn("_low", F.lower("line")).withColumn("_low_bare", F.lower("bare"))
    # in a lambda, since all rules in one generated method are more than the JVM compiles: it would run unoptimized or not at all
    once = F.array(F.struct("line", "bare", "_low", "_low_bare"))
    of_line = lambda r: F.flatten(F.transform(once, lambda x: _line_findings(x["line"], x["bare"], x["_low"], x["_low_bare"], r)))
    context = F.substring(F.trim("line"), 1, 200).alias("context")
    if own:
        found = lows(lines).select(key, "line_no", "line", F.explode(of_line(own)).alias("f"))
        parts.append(found.select(key, "f.*", "line_no", context))
    if whole := [r for r in rules if r.scope == "file"]:
        # the first line of each rule, and whether some line excuses the file: patterns and excuses are looked for as rules by number
        parts_of = [Rule(str(i), r.pattern, r.severity, None, r.family, "file") for i, r in enumerate(whole)]
        parts_of += [Rule(str(-1 - i), r.unless, r.severity, None, r.family, "file") for i, r in enumerate(whole) if r.unless]
        met = lows(lines).select(key, "line_no", "line", F.explode(of_line(parts_of)).alias("f")).select(key, F.col("f.rule").cast("int").alias("n"), F.struct("line_no", context).alias("at"))
        i, excuse = F.when(F.col("n") < 0, -1 - F.col("n")).otherwise(F.col("n")), F.col("n") < 0
        files = met.groupBy(key, i.alias("i")).agg(F.min(F.when(~excuse, F.col("at"))).alias("at"), F.max(excuse).alias("excused")).where("at is not null and not excused")
        told = F.element_at(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.family).alias("family")) for r in whole]), F.col("i") + 1)
        parts.append(files.select(key, told.alias("f"), "at").select(key, "f.*", "at.line_no", "at.context"))
    if loops := [r for r in rules if r.scope == "loop"]:
        inside = df.select(F.col(key), F.explode(loop_lines(F.col(text))).alias("l")).select(key, F.col("l.line_no").alias("line_no"), F.col("l.line").alias("line"))
        found = lows(inside.withColumn("bare", without_comments(F.col("line")))).select(key, "line_no", "line", F.explode(of_line(loops)).alias("f"))
        parts.append(found.select(key, "f.*", "line_no", context))
    if tight := [r for r in rules if r.scope == "squeezed"]:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:])//.*$", "$1"), r"\s+", "")
        found = lows(df.select(F.col(key), bare.alias("bare"), bare.alias("line"))).select(key, F.explode(of_line(tight)).alias("f"))
        parts.append(found.select(key, "f.*", F.lit(None).cast("int").alias("line_no"), F.lit("").alias("context")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def loop_lines(text: Column) -> Column:
    """Array of structs (line_no, line) of the lines within loop bodies: by braces, or in Python by indentation.

    A loop's own header is no part of its body, unless the loop is inside another one or has its body on that line.
    """
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    count = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))

    def step(acc: Column, x: Column) -> Column:
        line = x["line"]
        bare = without_comments(line)
        blank = F.trim(line) == ""
        indent = F.length(line) - F.length(F.ltrim(line))
        # loops that are over: braces closed down to where they began, or indentation back at theirs
        depth = acc["depth"] + count(bare, "{") - count(bare, "}")
        python = F.when(blank, acc["python"]).otherwise(F.filter(acc["python"], lambda p: p < indent))
        header, py_header = bare.rlike(LOOP), bare.rlike(r"^\s*(async\s+)?(for|while)\b.*:\s*$")
        same_line = header & bare.rlike(r"\)\s*\{?\s*[^\s{]|=>\s*\S")
        inside = ~blank & ((F.size(acc["loops"]) > 0) | (F.size(python) > 0) | (same_line & ~bare.rlike(r"\{\s*$")))
        loops = F.filter(F.when(header & (depth > acc["depth"]), F.concat(acc["loops"], F.array(acc["depth"]))).otherwise(acc["loops"]), lambda d: d < depth)
        return F.struct(
            depth.alias("depth"), loops.alias("loops"),
            F.when(py_header, F.concat(python, F.array(indent))).otherwise(python).alias("python"),
            F.when(inside, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        )

    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("depth"), none.alias("loops"), none.alias("python"), F.array().cast("array<struct<line_no:int,line:string>>").alias("out"))
    return F.aggregate(lines, zero, step, lambda acc: acc["out"])


def audit(findings: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``(family, findings, files, score, grade)``: 100 less the findings' costs, by severity and per hundred files.

    A distinct file, rule and line counts once. Families without findings have no row.
    """
    cost = F.create_map(*[F.lit(x) for pair in _SEVERITY_COST.items() for x in pair])
    once = findings.select(key, "family", "rule", "severity", "line_no").distinct()
    per = once.groupBy("family").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct(key).alias("files"), F.sum(cost[F.col("severity")]).alias("cost"))
    total = files.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    score = F.greatest(F.lit(0), F.lit(100) - F.floor(F.col("cost") * 100 / F.greatest(F.col("total"), F.lit(100)) + 0.5)).cast("long")
    grade = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")
    return per.crossJoin(F.broadcast(total)).select("family", "findings", "files", score.alias("score"), grade.alias("grade"))


def branch_complexity(source: Column) -> Column:
    """1 + branches; an ``else if`` counts for ``if`` and for ``else if``."""
    patterns = [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcase\s", r"\bcatch\s*\(", r"\?[^.?:]", r"&&|\|\|"]
    total = F.lit(1)
    for p in patterns:
        total = total + F.size(F.regexp_extract_all(source, F.lit(p), F.lit(0)))
    return total


def nesting_depth(source: Column) -> Column:
    """The greatest depth of openers less closers, line by line, blank and comment lines skipped."""
    body = F.filter(F.transform(F.split(source, "\n"), F.trim), lambda x: ~x.rlike(r"^(//|\*|$)"))

    def step(acc: Column, x: Column) -> Column:
        opens = F.when(x.rlike(r"\{\s*$"), 1).otherwise(0)
        closes = F.when(x.rlike(r"^\}"), 1).otherwise(0)
        now = F.greatest(acc["now"] + opens - closes, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(body, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def tag_depth(html: Column) -> Column:
    """The greatest depth of element tags, void and self-closing ones aside."""
    tags = F.regexp_extract_all(html, F.lit(r"</?[a-zA-Z][^>]*>"), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        void = x.rlike(r"(?i)^<(br|hr|img|input|link|meta)\b|/>$")
        now = F.when(void, acc["now"]).when(x.startswith("</"), F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"] + 1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(tags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])
