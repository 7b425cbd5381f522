"""The rule catalog as data: identifiers, weights, texts and patterns, in catalog order.

Patterns are written in the usual ECMAScript notation and translated to the engine's dialect by functions.dialect.
"""

# Results must show these texts, and hits depend on these patterns.

LINE_RULES = [
    dict(id='conflict-markers', title='Merge conflict markers committed', category='Correctness', severity='critical', confidence=0.99, cwe='CWE-1164', owasp=None, view='raw', cap=20, files=None, ignore_case=False,
         pattern=r"^(<{7}|>{7})(\s|$)|^={7}$",
         why="Unresolved merge-conflict markers won't compile or run — this code was never actually merged.",
         fix='Resolve the conflict and delete the <<<<<<< ======= >>>>>>> markers.'),
    dict(id='private-key', title='Private key material added', category='Secrets', severity='critical', confidence=0.98, cwe='CWE-798', owasp='A07:2021', view='raw', cap=5, files=None, ignore_case=False,
         pattern=r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----",
         why='A private key in source control is compromised the moment it is pushed.',
         fix='Remove the key, rotate it immediately, and load it from a secret store or env var.'),
    dict(id='aws-key', title='AWS access key ID added', category='Secrets', severity='critical', confidence=0.95, cwe='CWE-798', owasp='A07:2021', view='raw', cap=5, files=None, ignore_case=False,
         pattern=r"\bAKIA[0-9A-Z]{16}\b",
         why='Hard-coded cloud credentials get scraped from repos within minutes and used to run up real bills.',
         fix='Revoke the key in IAM, rotate it, and move it to environment configuration.'),
    dict(id='provider-token', title='Provider secret / token added', category='Secrets', severity='critical', confidence=0.95, cwe='CWE-798', owasp='A07:2021', view='raw', cap=8, files=None, ignore_case=False,
         pattern=r"\b(?:gh[pousr]_[0-9A-Za-z]{30,}|xox[baprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_\-]{35}|glpat-[0-9A-Za-z_\-]{20})\b",
         why='This matches a live token format (GitHub, Slack, Stripe, Google, GitLab). Treat it as leaked.',
         fix='Revoke the token with the provider and issue a new one stored outside the repo.'),
    dict(id='jwt', title='Hard-coded JWT', category='Secrets', severity='high', confidence=0.7, cwe='CWE-798', owasp='A07:2021', view='raw', cap=5, files=None, ignore_case=False,
         pattern=r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,}\b",
         why='A committed JWT often carries a real session or signing context and can be replayed.',
         fix="Remove the token; if it's a real credential, revoke the session and rotate the signing key."),
    dict(id='generic-secret', title='Hard-coded credential assignment', category='Secrets', severity='high', confidence=0.75, cwe='CWE-798', owasp='A07:2021', view='raw', cap=8, files=None, ignore_case=True,
         pattern=r"""(?:api[_-]?key|apikey|secret|access[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|pwd)\s*[:=]\s*["'][^"'\s]{8,}["']""",
         why='Secrets belong in environment variables or a vault, not in code. Anyone with repo access now has this.',
         fix='Replace the literal with a reference to config/secret storage and rotate the exposed value.'),
    dict(id='basic-auth-url', title='Credentials embedded in URL', category='Secrets', severity='high', confidence=0.8, cwe='CWE-798', owasp='A07:2021', view='string', cap=6, files=None, ignore_case=True,
         pattern=r"\b[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s:@]+@",
         why='A user:password@host URL leaks the credential into logs, history, and referrers.',
         fix='Move the username/password out of the URL into headers or a credential store.'),
    dict(id='eval-exec', title='Dynamic code execution', category='Injection', severity='high', confidence=0.7, cwe='CWE-95', owasp='A03:2021', view='code', cap=10, files='is_code', ignore_case=False,
         pattern=r"(?:^|[^.\w])(?:eval|exec)\s*\(|new\s+Function\s*\(",
         why='eval/exec runs arbitrary strings as code. If any part comes from input, this is remote code execution.',
         fix='Remove dynamic execution; use a parser, a lookup table, or JSON.parse for data.'),
    dict(id='shell-injection', title='Shell command from untrusted input', category='Injection', severity='high', confidence=0.8, cwe='CWE-78', owasp='A03:2021', view='code', cap=10, files=None, ignore_case=False,
         pattern=r"os\.system\s*\(|subprocess\.(?:call|run|Popen)\([^)]*shell\s*=\s*True|child_process\.exec\s*\(|Runtime\.getRuntime\(\)\.exec",
         why='Building shell commands from variables invites command injection.',
         fix='Use an argument array (execFile/spawn, subprocess without shell=True) and never interpolate input.'),
    dict(id='sql-concat', title='SQL built by string concatenation', category='Injection', severity='high', confidence=0.75, cwe='CWE-89', owasp='A03:2021', view='raw', cap=10, files=None, ignore_case=True,
         pattern=r"""(?:SELECT|INSERT|UPDATE|DELETE)\b[^;\n]*(?:["'`]\s*(?:\+|\.|%|\$\{)|f["'].*\{)""",
         why='Concatenating values into SQL enables injection — the classic database breach.',
         fix='Use parameterized queries / bound placeholders; never build SQL by string.'),
    dict(id='nosql-where', title='NoSQL $where / JS expression query', category='Injection', severity='high', confidence=0.6, cwe='CWE-943', owasp='A03:2021', view='code', cap=6, files=None, ignore_case=False,
         pattern=r"\$where\s*:|\bmapReduce\s*\(|\$function\s*:",
         why='A $where or JS-expression query runs on the DB engine and is injectable from input.',
         fix='Replace with structured query operators; validate and type-check inputs.'),
    dict(id='template-injection', title='Server-side template from input', category='Injection', severity='high', confidence=0.55, cwe='CWE-1336', owasp='A03:2021', view='code', cap=6, files=None, ignore_case=False,
         pattern=r"render_template_string\s*\(|Template\s*\(\s*[a-zA-Z_]|new\s+Template\s*\(\s*req\.",
         why='Rendering a template built from input allows server-side template injection (SSTI).',
         fix='Render static templates and pass data as context, never build the template from input.'),
    dict(id='prototype-pollution', title='Prototype pollution sink', category='Injection', severity='high', confidence=0.5, cwe='CWE-1321', owasp='A03:2021', view='code', cap=6, files='js_like', ignore_case=False,
         pattern=r"""\.__proto__\b|(?:^|[^"'\w])__proto__\s*:|\bconstructor\s*\.\s*prototype\b|\bObject\.prototype\s*\[""",
         why='Writing through __proto__ or constructor.prototype can poison every object in the runtime — a prototype-pollution attack.',
         fix='Reject __proto__/constructor keys when merging input; use Map, Object.create(null), or a vetted deep-merge that guards these keys.'),
    dict(id='raw-html', title='Unescaped HTML injection', category='XSS', severity='high', confidence=0.65, cwe='CWE-79', owasp='A03:2021', view='code', cap=12, files='js_like', ignore_case=False,
         pattern=r"\.innerHTML\s*=|dangerouslySetInnerHTML|document\.write\s*\(|insertAdjacentHTML\s*\(|v-html\s*=",
         why='Writing raw HTML from data is the classic XSS vector.',
         fix='Use textContent / safe binding, or sanitize with a vetted library (DOMPurify) before insertion.'),
    dict(id='js-scheme', title='javascript: URL sink', category='XSS', severity='medium', confidence=0.5, cwe='CWE-79', owasp='A03:2021', view='string', cap=6, files='js_like', ignore_case=True,
         pattern=r"""javascript:\s*[^"'\s]""",
         why='A javascript: URL executes code when followed — a common XSS payload.',
         fix='Allow only http/https/mailto schemes; reject javascript: and data: for links.'),
    dict(id='open-redirect', title='Redirect to a user-supplied URL', category='XSS', severity='medium', confidence=0.45, cwe='CWE-601', owasp='A01:2021', view='code', cap=6, files=None, ignore_case=False,
         pattern=r"(?:res\.redirect|response\.redirect|redirect|sendRedirect|window\.location(?:\.href)?\s*=|location\.replace\s*\()\s*\(?[^)\n]*(?:req\.|request\.|params|query|input|getParameter)",
         why="Redirecting to an input-derived URL enables open-redirect phishing — your domain sends users to an attacker's.",
         fix='Redirect only to allow-listed paths, or validate the target is same-origin before redirecting.'),
    dict(id='tls-off', title='TLS / certificate verification disabled', category='Crypto', severity='high', confidence=0.9, cwe='CWE-295', owasp='A02:2021', view='code', cap=8, files=None, ignore_case=True,
         pattern=r"""verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|CURLOPT_SSL_VERIFYPEER\s*,\s*(?:0|false)|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0""",
         why='Turning off certificate checks defeats HTTPS and exposes traffic to man-in-the-middle attacks.',
         fix='Re-enable verification; if a cert is self-signed, add it to the trust store instead.'),
    dict(id='weak-crypto', title='Weak hashing / cipher', category='Crypto', severity='medium', confidence=0.7, cwe='CWE-327', owasp='A02:2021', view='code', cap=8, files=None, ignore_case=False,
         pattern=r"""\b(?:md5|sha1)\s*\(|hashlib\.(?:md5|sha1)\s*\(|\bDES\b|\bRC4\b|createHash\(\s*["'](?:md5|sha1)["']""",
         why='MD5/SHA-1/DES/RC4 are broken for security use.',
         fix='Use SHA-256+ for integrity, and bcrypt/scrypt/argon2 for passwords, AES-GCM for encryption.'),
    dict(id='insecure-random', title='Insecure randomness for security value', category='Crypto', severity='medium', confidence=0.4, cwe='CWE-338', owasp='A02:2021', view='code', cap=6, files=None, ignore_case=False,
         pattern=r"Math\.random\s*\(\)|random\.randint\s*\(|new\s+Random\s*\(",
         why='Math.random and friends are not cryptographically secure — unsafe for tokens, IDs, or keys.',
         fix='Use a CSPRNG: crypto.randomBytes, secrets (Python), or java.security.SecureRandom.'),
    dict(id='ecb-mode', title='ECB cipher mode', category='Crypto', severity='medium', confidence=0.7, cwe='CWE-327', owasp='A02:2021', view='code', cap=4, files=None, ignore_case=True,
         pattern=r"""AES/ECB|MODE_ECB|["']aes-\d+-ecb["']""",
         why='ECB mode leaks plaintext patterns — identical blocks encrypt identically.',
         fix='Use an authenticated mode like AES-GCM with a unique nonce per message.'),
    dict(id='insecure-deserialize', title='Unsafe deserialization', category='Deserialization', severity='high', confidence=0.8, cwe='CWE-502', owasp='A08:2021', view='code', cap=6, files=None, ignore_case=False,
         pattern=r"pickle\.loads?\s*\(|yaml\.load\s*\((?![^)]*Loader)|Marshal\.load|ObjectInputStream|cPickle\.loads?\s*\(",
         why='Deserializing untrusted data can execute arbitrary objects.',
         fix='Use safe loaders (yaml.safe_load, JSON) and never deserialize attacker-controlled bytes.'),
    dict(id='path-traversal', title='Possible path traversal', category='Path', severity='medium', confidence=0.4, cwe='CWE-22', owasp='A01:2021', view='code', cap=6, files=None, ignore_case=False,
         pattern=r"(?:open|readFile|readFileSync|sendFile|createReadStream)\s*\([^)]*(?:req\.|request\.|params|query|input|argv)",
         why='Building a file path from input can let an attacker read ../ outside the intended directory.',
         fix='Resolve and validate the path against an allow-listed base directory before use.'),
    dict(id='ssrf', title='Request to a user-supplied URL', category='SSRF', severity='medium', confidence=0.4, cwe='CWE-918', owasp='A10:2021', view='code', cap=6, files=None, ignore_case=False,
         pattern=r"(?:requests\.get|axios\.get|fetch|urlopen|http\.get)\s*\([^)]*(?:req\.|request\.|params|query|input)",
         why='Fetching a URL from input enables SSRF — reaching internal services or cloud metadata.',
         fix='Validate the host against an allow-list and block private/link-local ranges.'),
    dict(id='debug-flag', title='Debug mode enabled', category='Config', severity='medium', confidence=0.7, cwe='CWE-489', owasp='A05:2021', view='code', cap=6, files=None, ignore_case=False,
         pattern=r"""DEBUG\s*=\s*True|app\.run\([^)]*debug\s*=\s*True|NODE_ENV\s*[:=]\s*["']?development|FLASK_DEBUG\s*=\s*1""",
         why='Debug mode can leak stack traces and internals — and interactive debuggers are RCE in prod.',
         fix='Drive debug from environment config and ensure production runs with it off.'),
    dict(id='cors-wildcard', title='Wide-open CORS', category='Config', severity='medium', confidence=0.7, cwe='CWE-942', owasp='A05:2021', view='raw', cap=6, files=None, ignore_case=True,
         pattern=r"""Access-Control-Allow-Origin["']?\s*[:,]\s*["']\*|cors\([^)]*origin\s*:\s*["']\*|"?\*"?\s*}\s*\)?\s*;?\s*//\s*cors""",
         why="A wildcard origin lets any site call this API with the user's credentials.",
         fix='Reflect only an allow-listed set of origins; never combine * with credentials.'),
    dict(id='bind-all', title='Service bound to 0.0.0.0', category='Config', severity='low', confidence=0.4, cwe='CWE-668', owasp='A05:2021', view='raw', cap=4, files=None, ignore_case=False,
         pattern=r"""0\.0\.0\.0|::/0|host\s*=\s*["']0\.0\.0\.0["']""",
         why='Binding to all interfaces / 0.0.0.0/0 can expose a service more widely than intended.',
         fix='Bind to localhost or a specific interface, and scope security-group / firewall rules.'),
    dict(id='insecure-cookie', title='Cookie without Secure/HttpOnly', category='Config', severity='low', confidence=0.4, cwe='CWE-614', owasp='A05:2021', view='code', cap=6, files=None, ignore_case=False,
         pattern=r"set_cookie\s*\(|res\.cookie\s*\(|new\s+Cookie\s*\(",
         why='Session cookies need Secure and HttpOnly, or they can leak over HTTP or to scripts.',
         fix='Set Secure, HttpOnly, and an appropriate SameSite attribute on session cookies.'),
    dict(id='hardcoded-ip', title='Hard-coded public IP address', category='Config', severity='low', confidence=0.35, cwe='CWE-547', owasp=None, view='raw', cap=5, files='is_code', ignore_case=False,
         pattern=r"(?:^|[^.\d])(?!(?:10|127|192\.168|169\.254)\.)(?!172\.(?:1[6-9]|2\d|3[01])\.)(?!0\.)(?:[1-9]\d{0,2})\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![.\d])",
         why='A hard-coded public IP is brittle and often a leftover from local testing — it breaks across environments and can pin traffic to the wrong host.',
         fix="Move the address to configuration / DNS; don't bake environment endpoints into code."),
    dict(id='bidi-unicode', title='Invisible bidirectional Unicode (trojan source)', category='Unicode', severity='critical', confidence=0.9, cwe='CWE-1007', owasp=None, view='raw', cap=6, files=None, ignore_case=False,
         pattern=r"[\u202A-\u202E\u2066-\u2069\u200E\u200F]",
         why='Bidi control characters can reorder how code reads to a human vs. the compiler — a trojan-source attack that hides logic in plain sight.',
         fix='Remove the bidirectional control characters; if RTL text is genuinely needed, isolate it in data, not code.'),
    dict(id='zero-width', title='Zero-width / invisible characters', category='Unicode', severity='medium', confidence=0.6, cwe='CWE-1007', owasp=None, view='raw', cap=6, files=None, ignore_case=False,
         pattern=r"[\u200B-\u200D\uFEFF\u2060]",
         why='Zero-width characters are invisible but change identifiers and strings — a source of subtle, hard-to-spot bugs and homoglyph tricks.',
         fix='Strip zero-width characters; verify identifiers are the ASCII you expect.'),
    dict(id='focused-test', title='Focused or skipped test', category='Testing', severity='medium', confidence=0.85, cwe='CWE-1164', owasp=None, view='code', cap=15, files=None, ignore_case=False,
         pattern=r"\b(?:describe|it|test)\.only\s*\(|\bf(?:describe|it)\s*\(|\bx(?:describe|it)\s*\(|\.skip\s*\(|@pytest\.mark\.skip|@unittest\.skip",
         why='A .only silently drops the rest of the suite; a .skip quietly disables coverage. Both hide failures.',
         fix='Remove .only / .skip before merging so the full suite runs in CI.'),
    dict(id='test-no-assert', title='Test with no assertion', category='Testing', severity='low', confidence=0.3, cwe='CWE-1164', owasp=None, view='code', cap=8, files='is_test', ignore_case=False,
         pattern=r"""\b(?:it|test)\s*\(\s*["'][^"']*["']\s*,\s*(?:async\s*)?\(\s*\)\s*=>\s*\{\s*\}\s*\)""",
         why='An empty test always passes and proves nothing.',
         fix='Add an assertion, or remove the placeholder test.'),
    dict(id='broad-except', title='Overly broad error handling', category='Correctness', severity='low', confidence=0.5, cwe='CWE-396', owasp=None, view='code', cap=15, files=None, ignore_case=False,
         pattern=r"except\s*:|except\s+Exception\s*:|catch\s*\(\s*(?:\)|e\s*\)\s*\{\s*\})|catch\s*\{\s*\}|rescue\s*=>\s*\w+\s*$",
         why='Swallowing every error hides real failures and makes bugs invisible.',
         fix='Catch specific exceptions and handle or re-raise the rest; at minimum, log it.'),
    dict(id='debug-print', title='Debug output left in code', category='Cleanliness', severity='low', confidence=0.6, cwe='CWE-489', owasp=None, view='code', cap=30, files='is_code', ignore_case=False,
         pattern=r"(?:^|[^.\w])(?:console\.(?:log|debug|dir)|debugger|System\.out\.print(?:ln)?|var_dump|print_r|binding\.pry|byebug|fmt\.Println)\s*[\(;]",
         why='Leftover debug output clutters logs and can leak data.',
         fix="Remove it, or route through the project's real logger at an appropriate level."),
    dict(id='stacktrace-print', title='Stack trace printed to output', category='Cleanliness', severity='low', confidence=0.55, cwe='CWE-209', owasp=None, view='code', cap=10, files='is_code', ignore_case=False,
         pattern=r"\.printStackTrace\s*\(|traceback\.print_exc\s*\(|console\.trace\s*\(|e\.printStackTrace",
         why='Printing a raw stack trace leaks internal paths and class names to logs or users, and usually means an error is being shown, not handled.',
         fix="Log through the real logger at error level and return a safe message; don't dump traces to stdout."),
    dict(id='todo', title='TODO / FIXME left in the change', category='Cleanliness', severity='low', confidence=0.7, cwe='CWE-546', owasp=None, view='comment', cap=30, files=None, ignore_case=True,
         pattern=r"\b(?:TODO|FIXME|HACK|XXX|WIP)\b",
         why='An unfinished marker in a submitted change is a promise of work not yet done.',
         fix='Finish it, or file a tracked issue and reference it.'),
    dict(id='long-line', title='Very long / possibly minified line', category='Cleanliness', severity='info', confidence=0.5, cwe='CWE-1121', owasp=None, view='raw', cap=5, files=None, ignore_case=False,
         pattern=r"^.{500,}$",
         why="A 500+ character line is usually minified or generated content that shouldn't be hand-edited in a PR.",
         fix='Commit generated artifacts separately, or keep source lines readable.'),
]

FILE_RULES = [
    dict(id='test-deleted', title='Test file deleted', category='Testing', severity='high', confidence=0.8, cwe='CWE-1164', owasp=None, cap=10,
         why='Removing tests lowers the safety net. Confirm the covered behavior is gone too, not just its test.',
         fix='Keep tests for behavior that still exists; if the feature is removed, say so in the PR.'),
    dict(id='secret-file', title='Secret / key file committed', category='Secrets', severity='critical', confidence=0.9, cwe='CWE-798', owasp='A07:2021', cap=5,
         why='Files like .env, *.pem or credentials should never be committed.',
         fix='Remove it, add it to .gitignore, and rotate anything it contained.'),
    dict(id='dep-change', title='Dependency manifest changed', category='Supply chain', severity='medium', confidence=0.6, cwe='CWE-1104', owasp='A06:2021', cap=6,
         why='New or bumped dependencies expand the attack surface.',
         fix="Review the changelog and lockfile diff; confirm the package name isn't a typosquat."),
    dict(id='migration', title='Database migration / schema change', category='Data', severity='medium', confidence=0.6, cwe='CWE-1188', owasp=None, cap=6,
         why='Schema changes are hard to roll back and can lock tables.',
         fix='Verify the migration is reversible and safe to run online under load.'),
    dict(id='infra-change', title='Infrastructure / CI change', category='Ops', severity='medium', confidence=0.6, cwe='CWE-1188', owasp='A05:2021', cap=6,
         why='CI, container and IaC edits change how everything builds and deploys — a typo here breaks the pipeline.',
         fix="Dry-run the change and confirm secrets/permissions aren't widened."),
    dict(id='large-file-churn', title='Large single-file change', category='Reviewability', severity='medium', confidence=0.7, cwe='CWE-1121', owasp=None, cap=8,
         why='A file with heavy churn is hard to review well.',
         fix='Split into smaller, focused commits or PRs where possible.'),
    dict(id='binary-added', title='Binary file added', category='Reviewability', severity='low', confidence=0.6, cwe='CWE-1121', owasp=None, cap=10,
         why="Binaries can't be reviewed line by line and bloat the repo.",
         fix='Confirm it belongs in the repo, not in asset storage or LFS.'),
    dict(id='lockfile-only-note', title='Lockfile updated', category='Supply chain', severity='info', confidence=0.5, cwe='CWE-1104', owasp=None, cap=4,
         why='Lockfile changes pin new transitive dependencies; usually fine but worth a glance.',
         fix='Skim for unexpected new packages or registry changes.'),
    dict(id='logic-without-tests', title='Code changed without matching tests', category='Testing', severity='medium', confidence=0.6, cwe='CWE-1164', owasp=None, cap=1,
         why='Substantial logic changed but no test file was touched. New behavior without a test can silently break.',
         fix='Add or update a test that exercises the changed behavior.'),
    dict(id='entropy-secret', title='High-entropy string (possible secret)', category='Secrets', severity='high', confidence=0.6, cwe='CWE-798', owasp='A07:2021', cap=8,
         why='A long, random-looking token was added in a string literal — the signature of a leaked credential.',
         fix="If it's a secret, remove and rotate it; store it in env/secret config."),
]
