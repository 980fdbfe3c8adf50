"""Names, patterns and lookup tables the log formats, the path
rules and the label rules define. They are data, not logic; results depend on
each being exactly as given.
"""

# -- record types and markers of log format A --------------------------------
BOOKKEEPING_TYPES = [
    "mode", "permission-mode", "bridge-session", "file-history-snapshot",
    "attachment", "ai-title", "last-prompt", "summary", "queued-prompt",
]
INTERRUPT_MARKERS = ["[Request interrupted by user", "[Request cancelled"]
COMMAND_MARKERS = ["<command-name>", "<local-command"]
TASK_NOTIFICATION = "task-notification"

# -- source tools ---------------------------------------------------------------
SOURCE_TOOLS = ["claude_code", "cursor", "codex"]

# -- file extension to language ---------------------------------------------
EXTENSION_LANGUAGE = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript",
    "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "json": "json",
    "jsonl": "json", "md": "markdown", "mdx": "markdown", "html": "html",
    "css": "css", "scss": "css", "toml": "toml", "yaml": "yaml", "yml": "yaml",
    "sh": "shell", "zsh": "shell", "bash": "shell", "rs": "rust", "go": "go",
    "java": "java", "kt": "kotlin", "swift": "swift", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "rb": "ruby", "php": "php",
    "sql": "sql", "svelte": "svelte", "vue": "vue", "txt": "text",
}

# -- path rules ---------------------------------------------------------------
TEST_DIR_PATTERN = r"(^|/)(tests?|__tests__|spec|specs)(/|$)"
TEST_NAME_PATTERN = r"(_test|\.test|_spec|\.spec|test_)[^/]*$"
TEST_NAME_SUFFIX = "test.java"
DOCS_EXTENSIONS = ["md", "mdx", "rst", "txt", "adoc"]
DOCS_DIR_PATTERN = r"(^|/)(docs?|documentation)(/|$)"
CONFIG_EXTENSIONS = ["json", "jsonl", "yaml", "yml", "toml", "ini", "cfg", "conf",
                     "properties", "env", "lock", "gradle", "xml"]
CONFIG_NAMES = ["dockerfile", "makefile", "gemfile", "rakefile", "procfile",
                ".gitignore", ".gitattributes", ".editorconfig", ".env"]
CONFIG_DIR_PATTERN = r"(^|/)(\.github|\.circleci|config|configs)(/|$)"
AGENT_PATH_MARKERS = [".claude/", "claude.md", ".cursorrules", ".cursor/", ".mcp.json", ".codex/"]
AGENT_NAMES = ["claude.md", "agents.md", ".claude", ".cursor", ".codex", ".cursorrules", ".mcp.json"]

# -- tool families -------------------------------------------------------------
BROWSER_MARKERS = ["mcp__claude-in-chrome__", "mcp__playwright__", "mcp__puppeteer__",
                   "computer", "browser_"]
WEB_TOOLS = ["WebSearch", "WebFetch", "web_search_call", "tool_search_call",
             "web_search", "web_fetch"]
READ_TOOLS = ["Read", "Grep", "Glob", "LS", "NotebookRead", "TodoRead",
              "TaskList", "TaskGet", "ListMcpResourcesTool", "ReadMcpResourceTool"]
EDIT_TOOLS = ["Edit", "Write", "MultiEdit", "NotebookEdit", "apply_patch"]
SHELL_TOOLS = ["Bash", "exec", "exec_command", "run", "js", "write_stdin", "shell"]

# -- language sets used where only a session's languages are known -----------
DOCS_LANGUAGES = ["markdown", "text"]
CONFIG_LANGUAGES = ["json", "yaml", "toml", "xml"]

# -- segmentation ---------------------------------------------------------------
TURN_GAP_MS = 30 * 60 * 1000

# -- commit message patterns ----------------------------------------------------
AI_TRAILER_PATTERN = (r"(?i)co-authored-by:.*\b(claude|codex|cursor|copilot|gpt|openai|"
                      r"anthropic|devin|aider|ai)\b")
REVERT_PATTERN = r"This reverts commit ([0-9a-f]{7,40})"
PR_MERGE_PATTERN = r"^Merge pull request #(\d+)"
PR_SQUASH_PATTERN = r"\(#(\d+)\)\s*$"
FIX_PATTERN = r"\b(fix|Fix|LANG-\d+|bug|Bug)\b"
NOISE_PATTERN = (
    r"Bump|dependabot|[Jj]avadoc|[Tt]ypo|spelling|checkstyle|CHANGES|README|"
    r"[Tt]est coverage|[Aa]dd missing test|[Ss]implify|[Rr]efactor|[Dd]eprecate|"
    r"[Rr]ename|[Ff]ormat|[Ss]tyle|PMD|SpotBugs|[Cc]omment")

# -- outcome windows, in days ---------------------------------------------------
SURVIVAL_HORIZONS = [30, 60, 90]
REWORK_WINDOW = 14

# -- fix mining limits -----------------------------------------------------------
MAIN_PREFIX = "src/main/java/"
TEST_PREFIX = "src/test/java/"
TEST_SUFFIX = "Test.java"
MAX_MAIN_FILES = 5
MAX_MAIN_CHURN = 250
MAX_OTHER_FILES = 2

# -- model id prefix to tier, in match order --------------------------------------
TIER_PREFIXES = [
    ("claude-fable-5", "frontier"), ("claude-opus", "frontier"),
    ("claude-sonnet", "mid"), ("claude-haiku", "small"),
    ("qwen", "open_weight"), ("deepseek", "open_weight"),
    ("llama", "open_weight"), ("meta-llama", "open_weight"),
    ("kimi", "open_weight"), ("glm", "open_weight"),
    ("mistral", "open_weight"), ("mixtral", "open_weight"),
    ("gpt-oss", "open_weight"), ("olmo", "open_weight"),
]
SYNTHETIC_MODEL = "<synthetic>"
AUTO_REVIEW_PREFIX = "codex-auto-review"

# -- price sheet columns -----------------------------------------------------------
RATES = ["input", "output", "cache_read", "cache_write_5m", "cache_write_1h"]
TOKEN_BUCKETS = ["input", "output", "cache_read", "cache_creation"]
BUCKET_RATE = {"input": "input", "output": "output", "cache_read": "cache_read",
               "cache_creation": "cache_write_1h"}
PER_TOKEN_FIELDS = {
    "input": "input_cost_per_token",
    "output": "output_cost_per_token",
    "cache_read": "cache_read_input_token_cost",
    "cache_write_5m": "cache_creation_input_token_cost",
    "cache_write_1h": "cache_creation_input_token_cost_above_1hr",
}
PROVIDER_PREFIXES = ["anthropic/", "openai/", "xai/"]

# -- versions written into records ---------------------------------------------------
SESSION_SCHEMA_VERSION = "0.4.0"
CONNECTOR_VERSION = "0.3.1"
CLASSIFIER_VERSION = "rules-0.1.1"
TAXONOMY_VERSION = "0.1.0"
