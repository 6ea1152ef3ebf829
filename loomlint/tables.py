"""Fixed values of the scoring model: small enough to be literals of a plan."""

# Dimensions and their weights, deductions by severity, dimensions by category.
DIMENSIONS = {"aiFaithfulness": 35, "codeFreshness": 25, "contextCoherence": 20, "implementationQuality": 20}
DEDUCTIONS = {"critical": 15, "high": 10, "medium": 5, "low": 2, "info": 0}
CATEGORY_DIMENSION = {
    "hallucination": "aiFaithfulness",
    "security": "aiFaithfulness",
    "training-leak": "aiFaithfulness",
    "stale-knowledge": "codeFreshness",
    "context-loss": "contextCoherence",
    "incomplete": "implementationQuality",
    "over-engineering": "implementationQuality",
    "duplication": "implementationQuality",
    "type-safety": "implementationQuality",
    "error-handling": "implementationQuality",
}
V4_CATEGORY = {"ai-faithfulness": "hallucination", "code-freshness": "stale-knowledge", "context-coherence": "context-loss", "implementation": "over-engineering"}
V4_SEVERITY = {"error": "critical", "warning": "medium", "info": "info"}
GRADES = [(95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D")]
LEGACY_WEIGHTS = {"completeness": 30, "coherence": 25, "consistency": 25, "conciseness": 20}
LEGACY_DEDUCTIONS = {"error": 10, "warning": 3}
BOT_PENALTIES = {"error": 15, "warning": 5, "info": 1}
SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
PASS_AT = 70
SLA_SECONDS = {"L1": 10, "L2": 30, "L3": 120}
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "typescript", ".jsx": "typescript",
    ".mjs": "typescript", ".cjs": "typescript", ".py": "python", ".java": "java", ".go": "go", ".kt": "kotlin", ".kts": "kotlin",
}
EXCLUDED_DIRS = ["node_modules", "dist", "build", ".git", "vendor", "__pycache__", "target"]
