"""Phrase lists, patterns, weights and limits that decide results.

Patterns are written for Python-like matching; ``java_pattern`` adds the flags that make
the JVM engine agree with it (Unicode classes, newline-only line ends).
"""

from __future__ import annotations

# --- fixed values: answers that report missing information -------------------------------
NO_INFO_PHRASES = [
    "no relevant",
    "cannot find",
    "no information",
    "don't have enough information",
    "no specific",
    "not mentioned",
    "not found",
    "cannot answer",
    "no answer",
    "not provided",
    "no context",
    "insufficient information",
]

# --- fixed values: substrings that mark a line as code -----------------------------------
CODE_MARKS = [
    "def ", "class ", "import ", "return ", "print(", "if __name__", ".py",
    "except:", "try:", "else:", "elif ", "    ", "\t",
]

# --- fixed values: Indonesian word patterns (whole words) --------------------------------
INDONESIAN_WORDS = [
    r"(?:yang|dengan|untuk|dari|kepada|adalah|tersebut|ini|itu)",
    r"(?:apa|siapa|mengapa|bagaimana|kapan|dimana|kemana)",
    r"(?:dan|atau|tetapi|namun|karena|sebab|jika|maka)",
    r"(?:di|ke|pada|dalam|tentang|mengenai|oleh)",
    r"meng[a-z]+",
    r"ber[a-z]+",
    r"pe[a-z]+an",
]

# --- own choice: stop-word profiles of the lexical language classifier -------------------
STOP_WORDS = {
    "en": "the of and to in is that for it was on are as with his they at be this have from or "
          "had by not but what all were when we there can an your which their if will each about "
          "how up out them then she many some so these would other into has her two him see could",
    "fr": "le la les de des du un une et est dans que qui pour par sur avec pas ne ce il elle au "
          "aux en se son sa ses plus mais ou nous vous ils sont cette leur être avoir fait comme",
    "de": "der die das und ist in zu den von mit sich des auf für nicht ein eine dem als auch es "
          "an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über zum",
    "es": "el la los las de y en que un una es por con para se del lo no su al como más pero sus "
          "le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde",
    "id": "yang dan di dengan untuk dari ini itu pada adalah tidak dalam akan ke oleh juga atau "
          "karena sebagai ada bisa saya kami mereka telah sudah lebih seperti namun tetapi jika",
    "ms": "yang dan di dengan untuk daripada ini itu pada ialah tidak dalam akan ke oleh juga atau "
          "kerana sebagai ada boleh saya kami mereka telah sudah lebih seperti tetapi jika iaitu",
    "jv": "lan ing sing iki iku ora karo kanggo saka wis arep ana uga marang dening nalika yaiku",
}

# --- fixed values: semantic types ---------------------------------------------------------
# name, patterns, keywords, indicators; order decides ties
SEMANTIC_TYPES = [
    ("DEFINITION",
     [r"(?:is|are) defined as\s+[^.]+\.",
      r"refers to\s+[^.]+\.",
      r"means\s+[^.]+\.",
      r"^definition:\s+[^.]+\.",
      r"(?:is|are) (?:a|an|the)\s+[^.]+\."],
     ["define", "definition", "means", "refers", "called", "known as", "understood as", "described as"],
     ["is", "are", "refers", "means", "defines", "represents"]),
    ("PROCEDURE",
     [r"(?:steps?|procedure|process|method)\s*:\s*(?:\d+\.|\-|\*)",
      r"(?:first|second|third|finally|lastly)(?:\s*,)?\s+[^.]+\.",
      r"^\d+\.\s+[^.]+\.",
      r"(?:follow|following) (?:these|the) steps"],
     ["step", "procedure", "process", "method", "instruction", "guide", "how to", "workflow", "sequence"],
     ["first", "then", "next", "finally", "lastly", "following"]),
    ("EXAMPLE",
     [r"(?:example|instance|illustration)[\s:]+",
      r"(?:e\.g\.|i\.e\.|for example|for instance)",
      r"such as\s+[^.]+\.",
      r"(?:consider|take|let's look at)\s+[^.]+\."],
     ["example", "instance", "illustration", "case", "scenario", "sample", "demonstration"],
     ["e.g.", "i.e.", "such as", "like", "consider"]),
    ("SUMMARY",
     [r"(?:in summary|to summarize|in conclusion)",
      r"^summary:\s+[^.]+\.",
      r"(?:key points|main points)\s*:",
      r"(?:to conclude|in closing|finally)"],
     ["summary", "conclusion", "overview", "recap", "key points", "main points", "takeaway"],
     ["summarize", "conclude", "summary", "finally", "overall"]),
    ("TABLE_REFERENCE",
     [r"(?:table|tbl\.|fig\.|figure)\s+\d+",
      r"as shown in\s+[^.]+\.",
      r"illustrated in\s+[^.]+\.",
      r"(?:refer to|see)\s+(?:table|figure)"],
     ["table", "figure", "diagram", "chart", "graph", "illustration", "visualization"],
     ["shown", "illustrated", "depicted", "displayed"]),
    ("CODE",
     [r"```[\s\S]*?```",
      r"(?:code|function|class|method)\s*\{",
      r"(?:def|class|function)\s+\w+\s*[\(\{]"],
     ["code", "function", "class", "method", "implementation", "algorithm", "snippet"],
     ["implement", "code", "function", "class", "return"]),
    ("EQUATION",
     [r"\$.*?\$",
      r"\\begin\{equation\}.*?\\end\{equation\}",
      r"(?:formula|equation):\s*[^.]+\."],
     ["equation", "formula", "calculation", "expression", "mathematical", "computation"],
     ["equals", "calculated", "computed", "derived"]),
    ("LIST",
     [r"(?:following|these|here are|:)\s*(?:\d+\.|\-|\*)",
      r"^\s*[•\-\*]\s+[^.]+\.",
      r"^\s*\d+\.\s+[^.]+\."],
     ["list", "items", "elements", "points", "components", "factors", "aspects"],
     ["include", "consist", "comprise", "contain"]),
    ("CITATION",
     [r"\[\d+\]",
      r"\(\w+\s*(?:et al\.?)?(?:,|\s)\s*\d{4}\)",
      r"according to\s+[^.]+\."],
     ["reference", "citation", "source", "cited", "according", "stated", "reported"],
     ["cited", "referenced", "reported", "stated"]),
    ("QUESTION",
     [r"\?\s*$",
      r"^(?:what|who|when|where|why|how)\s+[^.]+\?",
      r"(?:question|query|problem):\s+[^.]+\?"],
     ["question", "query", "problem", "ask", "inquire", "wonder", "explain"],
     ["what", "who", "when", "where", "why", "how"]),
]
TYPE_WEIGHTS = {"pattern": 0.4, "keyword": 0.3, "indicator": 0.2, "linguistic": 0.1}
TYPE_MIN_SCORE = 0.5
EXAMPLE_WORDS = ["like", "such"]

# --- fixed values: importance score --------------------------------------------------------
IMPORTANCE_WEIGHTS = {"references": 0.3, "position": 0.2, "semantic": 0.5}
IMPORTANCE_BY_TYPE = {"definition": 1.0, "procedure": 0.9, "example": 0.7, "table_reference": 0.8, "general": 0.5}

# --- fixed values: key-phrase patterns -----------------------------------------------------
NAME_PATTERN = r"\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\b"
NUMBER_PATTERN = r"\b\d+(?:[.,]\d+)?(?:\s*(?:%|percent|kg|km|miles|dollars|euros))?\b"
QUOTE_PATTERN = r'"([^"]+)"'
TERM_PATTERN = r"\b(?:[A-Z][a-z]+(?:\d+)?|[A-Z]{2,})\b"

# --- fixed values: similarity weights ------------------------------------------------------
SIMILARITY_WEIGHTS = {"cosine": 0.4, "ngram": 0.2, "phrase": 0.25, "word": 0.15}
NGRAM_WEIGHTS = {"char": 0.3, "word": 0.7}
OVERLAP_THRESHOLD = 0.75
HIGHLIGHT_BASE = 0.3
HIGHLIGHT_SHORT = (30, 1.2)
HIGHLIGHT_LONG = (200, 0.8)
HIGHLIGHT_BOOST = 1.25

# --- fixed values: answer parsing ----------------------------------------------------------
USED_SECTION = r"used chunks:\s*\[(.*?)\]"
USED_ENTRY = r"""(\d+)(?:\s+from\s+|\s+in\s+|\s+of\s+)["']?([^"',]+)["']?"""
SCORE_PATTERNS = [
    r"Chunk.*?(\d+)/10",
    r"Score:?\s*(\d+)\s*/?\s*10?",
    r"Rating:?\s*(\d+)",
    r"Relevance:?\s*(\d+)",
    r"Chunk.*?score.*?(\d+)",
    r"(\d+)\s*out of\s*10",
    r"(\d+)\s*points",
]
DOCUMENT_PATTERNS = [
    r"Document:\s*([^:\n]+?)(?:\n|$)",
    r"Document:\s*([^:\n]+?)(?=\s*Used as|$)",
    r"Document:\s*([^:\n]+?)(?=\s*Score|$)",
    r"([^:\n]+?\.(?:pdf|txt|docx))\s*(?:was used|is relevant|Used as)",
    r'From\s+"([^"\n]+?)"',
    r"From\s+'([^'\n]+?)'",
    r"Source:\s*([^:\n]+?)(?:\n|$)",
]
NEGATIVE_CUES = ["not used", "irrelevant", "unrelated", "not relevant", "not a source",
                 "not referenced", "not cited"]
RERANK_WEIGHTS = {"llm": 0.89, "initial": 0.11}
RERANK_GAP = 0.1

# --- fixed values: limits ------------------------------------------------------------------
MAX_BYTES = 50 * 1024 * 1024
TEXT_EXTENSIONS = ["txt", "md"]
CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
TITLE_MAX, TITLE_SOFT, TITLE_COMBINE = 1000, 800, 500
RETRIEVAL_DEFAULTS = {"chunks_per_doc": 3, "max_total_chunks": 10, "similarity_threshold": 0.75,
                      "default_language": "en"}
DEFAULT_PROVIDER = "azure-gpt"

# --- fixed values: graph edge weights ------------------------------------------------------
EDGE_WEIGHTS = {"hierarchical": 1.0, "contains": 1.0, "reference": 0.8, "semantic": 0.6,
                "adjacent": 0.4, "keyword": 0.3}


def java_pattern(pattern: str, flags: str = "") -> str:
    """Prefix that gives a JVM pattern Python's Unicode classes and newline rules."""
    return f"(?{flags}dU){pattern}"
