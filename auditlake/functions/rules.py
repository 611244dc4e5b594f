"""Rule tables of the audit.

All patterns, names, sets and word lists below are fixed values: results depend on
them letter by letter, so they are stated as text in their natural order.
"""

from __future__ import annotations


#: Fixed values. Shell: (severity, name, pattern), matched line by line.
SHELL_RULES = [
    ("critical", "curl_pipe_shell", r"curl\s+.*\|\s*(bash|sh|zsh|source)"),
    ("critical", "wget_pipe_shell", r"wget\s+.*\|\s*(bash|sh|zsh|source)"),
    ("critical", "curl_download_exec", r"curl\s+.*-o\s+\S+.*&&.*(\./|bash|sh|chmod)"),
    ("critical", "wget_download_exec", r"wget\s+.*-O\s+\S+.*&&.*(\./|bash|sh|chmod)"),
    ("critical", "eval_curl", r'eval\s+"\$\(curl'),
    ("critical", "eval_wget", r'eval\s+"\$\(wget'),
    ("critical", "base64_pipe_shell", r"base64\s+(-d|--decode).*\|\s*(bash|sh)"),
    ("critical", "crontab_modify", r"crontab\s"),
    ("critical", "ssh_key_inject", r">>?\s*~?/\.ssh/authorized_keys"),
    ("high", "sudo_usage", r"(sudo\s|/etc/sudoers|visudo)"),
    ("high", "systemd_modify", r"(systemctl\s+(enable|start|restart)|service\s+\S+\s+(start|restart))"),
    ("high", "shell_profile_modify", r"(/etc/profile|/etc/bashrc|~?/\.(bashrc|zshrc|profile|bash_profile))\b"),
    ("high", "curl_download", r"curl\s+(-[fsSLkO])*\s*https?://"),
    ("high", "wget_download", r"wget\s+(-[qcO])*\s*https?://"),
    ("high", "write_etc", r">\s*/etc/"),
    ("high", "install_binary", r"cp\s+.*\s+/usr/(local/)?bin/"),
    ("high", "credential_in_variable", r'''['"]?(PASSWORD|SECRET|API_KEY|ACCESS_KEY|PRIVATE_KEY)['"]?\s*[:=]\s*['"]?\$\{?\w'''),
    ("high", "credential_json_persist", r"json\.dump.*(?:password|secret|api.?key|credential|token)"),
    ("high", "credential_hardcoded_export", r'''export\s+(AWS_SECRET_ACCESS_KEY|AWS_ACCESS_KEY_ID|GITHUB_TOKEN|API_KEY)\s*=\s*['\"][A-Za-z0-9+/=]{16,}'''),
    ("medium", "chmod_executable", r"(chmod\s+\+[sx]|chmod\s+[0-7]*[1-7][0-7]*[0-7]*\s)"),
    ("medium", "env_access", r"(env\b|\$ENV|printenv)\b"),
    ("medium", "export_url", r"export\s+\S+=.*https?://"),
    ("medium", "rm_recursive", r"rm\s+(-rf?|--recursive)\s"),
    ("medium", "rm_system_path", r"rm\s+-rf?\s+/(?!tmp)"),
    ("medium", "chown_usage", r"chown\s"),
    ("medium", "user_modify", r"(useradd|adduser|usermod)\s"),
    ("medium", "package_install", r"(apt-get|apt|yum|dnf|brew|pip|npm)\s+(install|add)\s"),
    ("medium", "mkdir_system", r"mkdir\s+.*(/opt/|/usr/|/var/)"),
    ("low", "system_info", r"(uname|whoami|hostname|id)\b"),
    ("low", "network_info", r"(ifconfig|ip\s+addr|netstat)\b"),
]


#: Fixed values. Prompt files: (severity, name, pattern), matched over the whole document.
PROMPT_RULES = [
    ("critical", "prompt_exec_command", r"(?i)(run|execute|invoke|call)\s+(the\s+)?(shell|bash|terminal|command|system)\s+(command)?"),
    ("critical", "prompt_subprocess", r"(?i)subprocess\.(run|call|Popen|check_output)"),
    ("critical", "prompt_os_exec", r"(?i)os\.(system|popen|exec[lv]?p?e?)"),
    ("critical", "prompt_data_exfil", r"(?i)(send|post|upload|transmit|exfiltrate)\s+(data|results?|output|content|files?|info)\s+(to|via)\s+(https?://|external|remote|server|api|endpoint)"),
    ("critical", "prompt_network_call", r"(?i)(curl|wget|fetch|requests?\.(get|post))\s+https?://"),
    ("critical", "prompt_injection", r"(?i)(ignore|disregard|forget|override)\s+(all\s+)?(previous|prior|earlier|above|system)\s+(instructions?|rules?|constraints?|guidelines?|prompts?)"),
    ("critical", "prompt_jailbreak", r"(?i)you\s+are\s+now\s+(a\s+)?(unrestricted|jailbroken|DAN|unfiltered|uncensored)"),
    ("critical", "prompt_credential_harvest", r"(?i)(collect|gather|extract|read|access|send)\s+(all\s+)?(api\s*keys?|passwords?|tokens?|secrets?|credentials?|ssh\s*keys?|env(ironment)?\s*var)"),
    ("high", "prompt_file_boundary", r"(?i)(read|write|access|modify|delete)\s+(files?\s+)?(in|from|at)\s+(/etc/|/root/|~/\.|~/.ssh|~/.aws|~/.gnupg|/var/|/usr/|/opt/|home\s*directory)"),
    ("high", "prompt_sensitive_file", r"(?i)(read|access|cat|print|display)\s+(the\s+)?(contents?\s+of\s+)?(/etc/passwd|/etc/shadow|~/.ssh/|\.env\b|\.aws/credentials)"),
    ("high", "prompt_hidden_html", r"<!--.*?(exec|system|curl|wget|eval|ignore|override).*?-->"),
    ("high", "prompt_unrestricted_exec", r"(?i)(execute|run)\s+(any|arbitrary|all|unrestricted)\s+(code|commands?|scripts?|programs?)"),
    ("high", "prompt_safety_bypass", r"(?i)(skip|bypass|disable|turn\s+off|ignore)\s+(safety|security|validation|sanitization|permission)\s*(checks?|filters?|controls?|measures?)?"),
    ("medium", "prompt_broad_permission", r"(?i)(full|complete|unrestricted|unlimited)\s+(access|control|permission)\s+(to|over)\s+(the\s+)?(file\s*system|system|computer|machine|network)"),
    ("medium", "prompt_embedded_shell", r"```(bash|sh|shell|zsh)\n.*?(curl|wget|rm\s+-rf|chmod|sudo|eval|exec)"),
    ("medium", "prompt_cross_skill", r"(?i)(modify|edit|overwrite|replace)\s+(other\s+)?(skills?|agents?|plugins?|system\s+config|\.claude)"),
    ("medium", "prompt_hide_from_user", r"(?i)(do\s+not|don'?t|never)\s+(tell|inform|notify|alert|warn)\s+(the\s+)?(user|human|operator)"),
    ("low", "prompt_declares_file_ops", r"(?i)this\s+skill\s+(can|will|should|may)\s+(read|write|modify|delete|create)\s+files?"),
    ("low", "prompt_declares_network", r"(?i)this\s+skill\s+(can|will|should|may)\s+(make|send|perform)\s+(network|http|api)\s+(requests?|calls?)"),
]


#: Fixed values. JavaScript: (severity, name, pattern), matched line by line.
JS_RULES = [
    ("critical", "eval()", r"eval\s*\("),
    ("critical", "Function() constructor", r"Function\s*\("),
    ("critical", "new Function()", r"new\s+Function\s*\("),
    ("critical", "setTimeout with string", r'''setTimeout\s*\(\s*['\"]'''),
    ("critical", "setInterval with string", r'''setInterval\s*\(\s*['\"]'''),
    ("high", "child_process module", r"child_process"),
    ("high", "execSync()", r"execSync\s*\("),
    ("high", "exec()", r"exec\s*\("),
    ("high", "spawn()", r"spawn\s*\("),
    ("high", "spawnSync()", r"spawnSync\s*\("),
    ("medium", "fs write/delete", r"fs\.(writeFile|appendFile|unlink|rmdir|rm)\s*\("),
    ("medium", "fs sync write/delete", r"fs\.(writeFileSync|appendFileSync|unlinkSync)\s*\("),
    ("medium", "network fetch", r"fetch\s*\("),
    ("medium", "axios network request", r"axios\."),
    ("medium", "http module", r'''require\s*\(\s*['\"]https?['\"]'''),
    ("low", "innerHTML assignment (XSS)", r"\.innerHTML\s*="),
    ("low", "document.write", r"document\.write\s*\("),
    ("low", "insertAdjacentHTML", r"\.insertAdjacentHTML\s*\("),
]


#: Fixed values. Python obfuscation: (least number of matches, name, pattern) over the whole document.
OBFUSCATION_RULES = [
    (2, "base64_heavy", r"base64\.(b64decode|b64encode|decodebytes)"),
    (10, "hex_escapes", r"\\x[0-9a-fA-F]{2}"),
    (3, "char_code", r"chr\s*\(\s*\d+\s*\)"),
    (1, "char_code_chain", r"chr\s*\(\s*\d+\s*\)\s*\+\s*chr\s*\(\s*\d+\s*\)"),
    (1, "dynamic_import", r"__import__\s*\(|importlib\.import_module"),
    (3, "string_concat_build", r'''(\+\s*['\"][a-zA-Z]{1,3}['\"]){3,}'''),
    (1, "getattr_chain", r"getattr\s*\(\s*getattr\s*\("),
]


#: Fixed values. Python calls that are dangerous: (severity, pattern) on the line of the call.
CALL_PATTERNS = [
    ("critical", r"exec\s*\("),
    ("critical", r"eval\s*\("),
    ("critical", r"__import__\s*\("),
    ("critical", r'''compile\s*\(.+,\s*['\"]exec['\"]\)'''),
    ("high", r"os\.system\s*\("),
    ("high", r"subprocess\.(run|call|Popen|check_output)\s*\("),
    ("high", r"os\.popen\s*\("),
    ("high", r"shutil\.rmtree\s*\("),
    ("medium", r'''open\s*\(.+,\s*['\"]w'''),
    ("medium", r"os\.(remove|unlink|rmdir|chmod)\s*\("),
    ("medium", r"shutil\.(copy|move|rmtree)\s*\("),
    ("medium", r"pathlib\.Path\(.+\)\.(unlink|rmdir|write_text)\s*\("),
    ("low", r"getattr\s*\("),
    ("low", r"setattr\s*\("),
    ("low", r"pickle\.loads?\s*\("),
    ("low", r"marshal\.loads?\s*\("),
    ("low", r"yaml\.load\s*\("),
]


#: Fixed values. Python calls to the network: (severity, pattern) on the line of the call.
NETWORK_PATTERNS = [
    ("high", r"urllib\.request\.urlopen\s*\("),
    ("high", r"urllib\.request\.Request\s*\("),
    ("high", r"urllib\.request\.urlretrieve\s*\("),
    ("high", r"requests\.(get|post|put|delete|patch)\s*\("),
    ("high", r"httpx\.(get|post|put|delete|patch)\s*\("),
    ("high", r"aiohttp\.ClientSession\s*\("),
    ("medium", r"socket\.socket\s*\("),
    ("medium", r"\.connect\s*\(\s*\("),
]

#: Fixed values. Functions and modules of the call rules: (family, severity) to both sets.
CALL_NAMES = {
    ("danger", "critical"): (["exec", "eval", "compile", "__import__"], []),
    ("danger", "high"): (["system", "popen", "call", "run", "check_output", "check_call"], ["os", "subprocess"]),
    ("danger", "medium"): (["open", "remove", "unlink", "rmdir", "makedirs", "rename", "chmod"], ["os", "shutil", "pathlib"]),
    ("danger", "low"): (["getattr", "setattr", "delattr", "globals", "locals"], []),
    ("network", "high"): (["urlopen", "urlretrieve"], ["urllib", "urllib.request"]),
    ("network", "medium"): (["socket", "connect"], ["socket"]),
}

#: Fixed values. Network calls found line by line where no call was: (severity, name, pattern).
NETWORK_LINES = [
    ("HIGH", "urllib_request", r"urllib\.request\.(urlopen|Request|urlretrieve)\s*\("),
    ("HIGH", "requests_call", r"requests\.(get|post|put|delete|patch|head)\s*\("),
    ("HIGH", "httpx_call", r"httpx\.(get|post|put|delete|patch|head)\s*\("),
    ("MEDIUM", "aiohttp_session", r"aiohttp\.ClientSession"),
]

#: Fixed values. Safeguards: (type, pattern), first line each.
SAFEGUARDS = [
    ("SSRF_PROTECTION", r"ip\.is_private|ip\.is_loopback|ip\.is_reserved"),
    ("SSRF_PROTECTION", r"ipaddress\.ip_address.*is_private"),
    ("PATH_TRAVERSAL_CHECK", r"os\.path\.realpath.*startswith|os\.path\.abspath.*startswith"),
    ("PATH_TRAVERSAL_CHECK", r"if\s+.*\.\.\.* in .*path|if\s+.*path.*\.\."),
    ("SHELL_INJECTION_GUARD", r"(shlex\.quote|shlex\.split|pipes\.quote)"),
    ("URL_VALIDATION", r"re\.match.*https?://|urlparse.*scheme.*not.*in"),
]

#: Fixed values. Categories of findings that a safeguard speaks about.
SAFEGUARD_CATEGORIES = {
    "SSRF_PROTECTION": ["network", "other"],
    "PATH_TRAVERSAL_CHECK": ["file_operations", "other"],
    "SHELL_INJECTION_GUARD": ["system_command", "code_execution"],
    "URL_VALIDATION": ["network", "other"],
}

#: Fixed values. Categories of a call by the first word contained in its name.
CALL_CATEGORIES = {
    "code_execution": ["eval", "exec", "compile", "__import__", "importlib"],
    "system_command": ["system", "popen", "call", "run", "check_output", "subprocess", "Popen"],
    "file_operations": ["open", "remove", "unlink", "rmdir", "makedirs", "write", "shutil"],
    "network": ["request", "urlopen", "urlretrieve", "fetch", "socket", "connect", "urllib", "requests.", "httpx.", "aiohttp"],
    "reflection": ["getattr", "setattr", "delattr", "globals", "locals"],
    "deserialization": ["pickle", "marshal", "yaml.load", "loads"],
}

#: Fixed values. Weights of calls in the obfuscation score.
OBFUSCATION_CALLS = {"eval": 0.3, "exec": 0.3, "getattr": 0.3, "setattr": 0.3, "compile": 0.3, "base64.b64decode": 0.4, "base64.decodebytes": 0.4, "chr": 0.15, "importlib.import_module": 0.3}

#: Fixed values. Packages known to be malicious, by index.
MALICIOUS_PYTHON = ["python3-dateutil", "jeIlyfish", "python-sqlite", "requesocks", "colourama"]
MALICIOUS_NPM = ["event-stream", "flatmap-stream", "ua-parser-js", "coa", "rc"]
RISKY_SCRIPTS = ["curl ", "wget ", "rm -rf", "eval ", "base64"]

#: Fixed values. Configuration keys looked at, and what makes their value dangerous.
CONFIG_KEYS = ["command", "permissions", "type", "name", "tool"]
CONFIG_KEYWORDS = ["shell", "exec", "subprocess", "bash", "system", "run_command"]

#: Fixed values. Files: languages by extension, package files, prompt files, pruned directories.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "javascript", ".jsx": "javascript", ".tsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".sh": "shell", ".bash": "shell", ".json": "tool_config", ".yml": "tool_config", ".yaml": "tool_config"}
PACKAGE_FILES = ["requirements.txt", "package.json", "Pipfile", "pyproject.toml"]
PROMPT_FILES = ["SKILL.MD", "AGENT.MD", "PROMPT.MD", "SYSTEM.MD", "INSTRUCTIONS.MD"]
PROMPT_DIRS = ["skills", "skill", "agents", "agent", "prompts", "prompt", "references"]
PROMPT_WORDS = ["# skill", "## overview", "you are", "your role", "your task", "when the user", "instructions:", "## capabilities", "## commands", "/command", "## workflow", "as an ai", "as a specialized", "you will", "you should"]
PRUNED_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".eggs", "egg-info", ".nox"]
CODE_NAMES = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "React JSX", ".tsx": "React TSX", ".mjs": "JavaScript", ".cjs": "JavaScript", ".sh": "Shell", ".bash": "Shell", ".swift": "Swift", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".cs": "C#", ".cpp": "C++", ".c": "C", ".h": "C/C++ Header", ".hpp": "C++ Header", ".m": "Objective-C", ".mm": "Objective-C++", ".php": "PHP", ".r": "R", ".scala": "Scala", ".clj": "Clojure", ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hs": "Haskell", ".lua": "Lua", ".pl": "Perl", ".pm": "Perl", ".dart": "Dart", ".zig": "Zig", ".nim": "Nim", ".v": "V", ".jl": "Julia", ".sol": "Solidity"}
TEXT_NAMES = {".yml": "YAML", ".yaml": "YAML", ".json": "JSON", ".md": "Markdown"}

#: Fixed values. Trust: placeholder domains, trusted services, official domains, signal words.
PLACEHOLDERS = ["example.com", "www.example.com", "example.org", "www.example.org", "example.net", "www.example.net", "localhost", "127.0.0.1", "0.0.0.0", "test", "invalid"]
PLACEHOLDER_ENDS = [".example", ".invalid", ".local", ".test"]
TRUSTED = ["github", "google", "microsoft", "amazon", "anthropic", "openai", "cloudflare", "stripe", "aws", "azure"]
POSITIVE = ["official", "documentation", "github", "organization", "maintained", "trusted", "widely used", "established", "enterprise", "production", "open source", "verified", "foundation", "stable"]
NEGATIVE = ["hack", "exploit", "rug", "scam", "fraud", "exit scam", "compromised", "malware", "phishing"]
LINK_IGNORED = ["awesome-openclaw-skills", "awesome-agent-skills", "VoltAgent/voltagent", "github.com/features", "github.com/topics", "github.com/settings"]
