"""What the SQL expects of the library's word lists, written out here, so that a wrong one there shows.

Fixed values of the format: markers and what each adds, words of a line's type, patterns of a directive (pattern, whether case is ignored),
patterns of a critical note.
"""

IMPORTANCE = [
    ("✅ 🎉 🚀 COMPLETE SUCCESS BREAKTHROUGH CRITICAL".split(), 0.4), ("✓ 🔥 IMPORTANT NOTE DECISION TODO".split(), 0.2), ("⚠️ 💭 idea consider".split(), 0.1),
]
LINE_TYPES = {
    "event": ["happened", "completed", "finished", "deployed", "launched", "✅", "🎉"], "decision": ["decided", "chose", "will", "going to", "decision"],
    "insight": ["learned", "realized", "discovered", "found", "💡", "insight"], "action": ["todo", "need to", "must", "should", "[ ]"],
}
POSITIVE = [(r"\bALWAYS\b", False), (r"\bMUST(?!\s+NOT)\b", False), (r"\bDO\b(?!\s+NOT)", False), (r"\bmandator(?:y|ily)\b", True), (r"\bmandate(?:d|s)?\b", True), (r"\bcompulsor(?:y|ily)\b", True)]
NEGATIVE = [
    (r"\bNEVER\b", False), (r"\bMUST\s+NOT\b", False), (r"\bDO\s+NOT\b", False), (r"\bDON'T\b", False), (r"\bprohibit(?:ed|s)?\b", True), (r"\bforbid(?:den|s)?\b", True), (r"\bdisallow(?:ed|s)?\b", True), (r"\bcannot\b", True),
]
LEADING_POSITIVE = [(r"\balways\b", True), (r"\bmust(?!\s+not)\b", True), (r"\bprefer\b", True), (r"\brequire(?:d|s)?\b", True)]
LEADING_NEGATIVE = [(r"\bnever\b", True), (r"\bmust\s+not\b", True), (r"\bdo\s+not\b", True), (r"\bdon't\b", True), (r"\bavoid\b", True), (r"\bskip\b", True)]
CRITICAL = [
    r"\bnever\b", r"\bmust\s+never\b", r"\bmust\s+not\b", r"\bsilently\s+(drops?|lose?s?|fails?)\b", r"\bdata\s+loss\b", r"\bwill\s+destroy\b", r"\bdestructive\b", r"\bblocker\b", r"\boverwrites?\b",
]
