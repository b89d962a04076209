"""Fixed values of the index format and of file handling.

They decide results (which files count, how text is cut, how ranks fuse), so they are
listed once, as they are.
"""

from __future__ import annotations

# --- fixed values: splitting ---
CHUNK_LINES = 40
CHUNK_STRIDE = 32
MAX_CHUNK_CHARS = 8000
MAX_FILE_BYTES = 1_048_576
BINARY_SNIFF_BYTES = 8192

# --- fixed values: search ---
OVERFETCH = 5
RRF_K = 60
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
EMBED_CHARS = 2048
QUERY_CACHE = 256
CONTEXT_RESULTS = 50
EMBED_DIM = 768
BATCH_AREA, BATCH_ROWS = 10_000_000, 16
TOKENS_PER_WORD = 1.3

# --- fixed values: languages by file suffix ---
LANGUAGES = {
    # code
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".rb": "ruby",
    ".cpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
    ".swift": "swift",
    ".kt": "kotlin",
    ".sh": "bash",
    ".sql": "sql",
    ".lua": "lua",
    ".r": "r",
    ".scala": "scala",
    ".zig": "zig",
    ".ex": "elixir",
    ".exs": "elixir",
    ".php": "php",
    # documents
    ".md": "markdown",
    ".mdx": "markdown",
    ".rst": "rst",
    ".txt": "text",
    # configuration
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".json": "json",
    ".ini": "ini",
    ".cfg": "config",
    ".conf": "config",
}

# --- fixed values: files that are never indexed ---
PRUNED_DIRS = ["node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".tox", ".mypy_cache"]
SKIPPED_NAMES = [
    ".env", ".env.*",
    "*.pem", "*.key", "*.crt", "*.cer", "*.p12", "*.pfx",
    "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa",
    "*.keystore", "*.jks",
    "credentials.json", "service-account*.json",
    ".aws", ".npmrc", ".pypirc",
    "*.lock",
    "*-lock.json", "*-lock.yaml", "*-lock.yml",
    "Pipfile.lock", "poetry.lock", "uv.lock", "Cargo.lock",
    "*.min.js", "*.min.css",
    "*.pyc", "*.pyo",
    "*.map",
    "*.bundle.js",
    "*.wasm", "*.so", "*.dylib", "*.dll",
    "*.exe", "*.bin",
    "*.sqlite", "*.sqlite3", "*.db",
    "*.parquet", "*.arrow", "*.feather",
    "*.pkl", "*.pickle",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg",
    "*.mp3", "*.mp4", "*.wav", "*.webm",
    "*.woff", "*.woff2", "*.ttf", "*.eot",
    "*.zip", "*.tar", "*.gz", "*.bz2", "*.xz", "*.7z",
]
SHOWN_DOTFILES = [".md", ".mdx", ".toml", ".rst"]
WATCHED_SUFFIXES = [
    ".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs",
    ".java", ".rb", ".cpp", ".c", ".cs", ".swift", ".kt",
    ".md", ".mdx", ".rst", ".txt", ".toml", ".yaml", ".yml",
    ".json", ".sql", ".sh",
]
DEBOUNCE_MS = 500
DEBOUNCE = f"{DEBOUNCE_MS} milliseconds"

# --- fixed values: declarations that start a chunk, by language (matched at the start of a line) ---
DECLARATIONS = {
    "typescript": r"^(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s+\w+|class\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:\(|function)|interface\s+\w+|type\s+\w+\s*=|enum\s+\w+)",
    "go": r"^(?:func\s+(?:\(\w+\s+\*?\w+\)\s+)?\w+|type\s+\w+\s+(?:struct|interface)|var\s+(?:\w+|[(])|const\s+(?:\w+|[(]))",
    "rust": r"^(?:pub(?:\s*\(crate\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl|mod|type|const|static)\s",
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]

#: Reserved repository of notes, and the prefix of their paths.
NOTE_REPO = "note://memory"
NOTE_PREFIX = NOTE_REPO + "/"
NOTE_LANGUAGE = "note"
IGNORE_FILE = ".quillignore"
SCHEMA_VERSION = 1
