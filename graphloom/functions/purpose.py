"""What a dependency is for, by its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Purposes by name of dependency.
KNOWN = {
    "anyhow": "Error handling with context chains",
    "thiserror": "Custom error types",
    "serde": "Serialise/deserialise framework",
    "serde_json": "JSON serialisation",
    "toml": "TOML parsing",
    "tokio": "Async runtime",
    "async-trait": "Async methods in traits",
    "futures": "Async combinators",
    "tracing": "Structured logging",
    "tracing-subscriber": "Logging output formatting",
    "log": "Logging facade",
    "env_logger": "Environment-driven logger",
    "chrono": "Date and time",
    "clap": "CLI argument parsing",
    "dirs": "Standard user directories",
    "sha2": "SHA-256/512 hashing",
    "blake3": "Fast cryptographic hashing",
    "uuid": "UUID generation",
    "regex": "Regular expressions",
    "rayon": "Data parallelism",
    "crossbeam": "Concurrent data structures",
    "notify": "Filesystem watching",
    "walkdir": "Recursive directory walking",
    "ignore": "Gitignore-aware file walking",
    "duckdb": "Embedded analytics database",
    "rusqlite": "SQLite bindings",
    "reqwest": "HTTP client",
    "axum": "HTTP server",
    "actix-web": "HTTP server",
    "hyper": "Low-level HTTP",
    "tower": "Service middleware",
    "ratatui": "Terminal UI framework",
    "crossterm": "Terminal manipulation",
    "tree-sitter": "Incremental parsing framework",
    "tree-sitter-rust": "Tree-sitter Rust grammar",
    "tree-sitter-typescript": "Tree-sitter TypeScript grammar",
    "tree-sitter-javascript": "Tree-sitter JavaScript grammar",
    "tree-sitter-python": "Tree-sitter Python grammar",
    "tree-sitter-go": "Tree-sitter Go grammar",
    "tree-sitter-java": "Tree-sitter Java grammar",
    "tree-sitter-php": "Tree-sitter PHP grammar",
    "tree-sitter-c-sharp": "Tree-sitter C# grammar",
    "git2": "Git bindings",
    "gix": "Pure-Rust git",
    "indicatif": "Progress bars",
    "dialoguer": "Interactive prompts",
    "console": "Terminal styling",
    "colored": "Terminal colours",
    "once_cell": "Lazy statics",
    "lazy_static": "Lazy statics",
    "itertools": "Iterator helpers",
    "rand": "Random number generation",
    "fastrand": "Fast random number generation",
    "base64": "Base64 encoding",
    "flate2": "DEFLATE/gzip compression",
    "mime_guess": "MIME-type guessing from path",
    "open": "Open a path in the user's default app",
    "rust-embed": "Embed files into the binary at build time",
    "tokio-stream": "Async stream combinators (Tokio)",
    "tokio-util": "Tokio helpers (codecs, frames)",
    "tower-http": "HTTP middleware (tower)",
    "async-stream": "Async stream macros",
    "fdg-sim": "Force-directed graph simulation",
    "graphology": "Graph data structures (JS)",
    "graphology-communities-louvain": "Louvain clustering (JS)",
    "graphology-layout-forceatlas2": "ForceAtlas2 layout (JS)",
    "sigma": "Graph rendering (JS)",
    "prism-react-renderer": "Syntax highlighting",
    "react": "UI rendering library",
    "react-dom": "React DOM renderer",
    "react-router": "Client-side routing",
    "react-router-dom": "React routing for browsers",
    "next": "Next.js framework",
    "vue": "Vue.js framework",
    "svelte": "Svelte framework",
    "vite": "Frontend dev server / bundler",
    "@vitejs/plugin-react": "Vite React plugin",
    "typescript": "TypeScript compiler",
    "eslint": "Linter",
    "prettier": "Code formatter",
    "tailwindcss": "CSS utility framework",
    "postcss": "CSS post-processor",
    "autoprefixer": "CSS vendor prefixing",
    "d3": "Data-driven SVG",
    "d3-force": "Force-directed layout",
    "d3-zoom": "SVG pan/zoom",
    "fuse.js": "Client-side fuzzy search",
    "zustand": "State management",
    "@tanstack/react-query": "Async data fetching cache",
    "axios": "HTTP client",
    "lodash": "Utility helpers",
    "zod": "Schema validation",
    "dayjs": "Date manipulation",
    "framer-motion": "Animation library",
    "clsx": "Conditional className helper",
    "vitest": "Test runner",
    "jest": "Test runner",
    "@testing-library/react": "React testing utilities",
    "@types/node": "Node.js TypeScript types",
    "@types/react": "React TypeScript types",
    "@types/react-dom": "React DOM TypeScript types",
    "requests": "HTTP client",
    "flask": "Web framework",
    "django": "Web framework",
    "fastapi": "ASGI web framework",
    "pydantic": "Data validation",
    "sqlalchemy": "ORM",
    "numpy": "Numerical arrays",
    "pandas": "Data analysis",
    "pytest": "Test runner",
    "github.com/gin-gonic/gin": "Web framework",
    "github.com/spf13/cobra": "CLI framework",
    "github.com/stretchr/testify": "Testing assertions",
}
#: Fixed value: what is said of a dependency that no rule knows.
UNKNOWN = "Uncategorised — see crate/package docs"


def by_name(name: Column) -> Column:
    """What a name that is not in the table gives away."""
    # Prefixes and parts of names, and what they stand for.
    grammar = F.when(F.startswith(name, F.lit("tree-sitter-")), F.concat(F.lit("Tree-sitter grammar for "), F.substring(name, F.lit(13), F.length(name))))
    types = grammar.when(F.startswith(name, F.lit("@types/")), F.concat(F.lit("TypeScript types for `"), F.substring(name, F.lit(8), F.length(name)), F.lit("`")))
    return types.when(F.startswith(name, F.lit("eslint-")), "ESLint plugin").when(F.contains(name, F.lit("logger")) | F.contains(name, F.lit("logging")), "Logging").otherwise(UNKNOWN)


def with_purpose(deps: DataFrame) -> DataFrame:
    """deps (name, ...) with their purpose; the table is broadcast."""
    known = deps.sparkSession.createDataFrame([*KNOWN.items()], "_name string, _purpose string")
    return deps.join(F.broadcast(known), deps["name"] == F.col("_name"), "left").select(*deps.columns, F.coalesce("_purpose", by_name(F.col("name"))).alias("purpose"))
