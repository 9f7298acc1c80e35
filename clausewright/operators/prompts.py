"""Generation prompts as data: axes, the text that they render to, and its identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.vocabulary import frame

# The registry's version, its axes and the lines of a prompt. A stored
# identity names the exact text, so every character counts.
REGISTRY = "doctype-prompts-v1"
PLACES = ("England & Wales", "Delaware USA", "New York USA", "Australia", "Singapore")
LENGTHS = ("short (1-2 pages)", "medium (3-6 pages)", "long (8-15 pages)")
REGISTERS = ("formal legal", "plain-English modern", "dense traditional boilerplate")
FORMATS = (
    ("markdown", 0.6, "Markdown with `#` headings, and tables as `| ... |` where natural."),
    ("plain", 0.25, "plain text only, no Markdown formatting or heading markers."),
    ("noisy_markdown", 0.15, "Markdown but imperfect, as if from an OCR/parser: some broken headings, stray line breaks, and minor artifacts."),
)
OTHER_FAMILIES = (
    "a corporate policy (code of conduct, data-protection or expenses policy)",
    "an employee benefit or pension plan document",
    "an IP registration certificate (granted patent or trademark)",
    "a purchase order or an invoice",
    "a routine regulatory filing cover or annual-return receipt",
    "another legal record outside our taxonomy (court docket sheet, power of attorney)",
    "an unrelated non-legal document (news article, product manual, recipe)",
)
CLASSES = (
    (
        "nda",
        "confidentiality / non-disclosure agreement between two parties",
        "definition of Confidential Information; permitted use; exclusions; term and survival; return/destruction; remedies; governing law",
        ("mutual or one-way variants", "a defined-terms section"),
    ),
    (
        "commercial_agreement",
        "commercial contract between a supplier/vendor and a customer (services, supply, distribution)",
        "scope of services/goods; pricing and payment; term and termination; warranties; limitation of liability; IP ownership; governing law",
        ("schedules/annexes for pricing or SOW", "order-of-precedence clause"),
    ),
    (
        "constitutional",
        "company constitutional document (articles of association / bylaws)",
        "share capital and classes; transfer of shares; directors and powers; general meetings and voting; dividends; pre-emption rights",
        ("article/section numbering", "references to the Companies Act or DGCL"),
    ),
)
OPENING = ("You are generating ONE synthetic ", " for a document-type classifier's TRAINING set.")
OTHER_OPENING = ("You are generating ONE synthetic ", " for the OUT-OF-TAXONOMY (`other`) class of a deal-document classifier's TRAINING set.")
OTHER_RULE = (
    "It must NOT be any deal/contract type (NDA, commercial, acquisition, lease, financing, IP, employment, constitutional, financial, etc.); "
    "it should be a realistic document that could be mistaken for one but is not."
)
INCLUDE = ("Include, where natural: ", ".")
RULES = (
    "",
    "Realism rules:",
    "- Use realistic party names, dates, defined terms, cross-references, boilerplate.",
    "- Vary whether an explicit title naming the document is present; do not make the class obvious from a single title line alone.",
    "- Do not mention that this is synthetic or reference these instructions.",
    "",
    "Return ONLY the document text.",
)


def prompt_axes(spark: SparkSession) -> DataFrame:
    """label, family (null but for "other"), head, tail, place, length, register, fmt,
    instruction: every prompt that can be asked for. head and tail are a class's lines
    before and after the axes."""
    own = [(name, None, OPENING[0] + summary + OPENING[1], "\n".join([INCLUDE[0] + parts + INCLUDE[1], *[f"- {r}" for r in realism]])) for name, summary, parts, realism in CLASSES]
    other = [("other", f, OTHER_OPENING[0] + f + OTHER_OPENING[1] + "\n" + OTHER_RULE, None) for f in OTHER_FAMILIES]
    axis = lambda values, name: F.broadcast(frame(spark, [(v,) for v in values], f"{name} string"))
    kinds = frame(spark, [*own, *other], "label string, family string, head string, tail string")
    formats = F.broadcast(frame(spark, [(n, i) for n, _, i in FORMATS], "fmt string, instruction string"))
    return kinds.crossJoin(axis(PLACES, "place")).crossJoin(axis(LENGTHS, "length")).crossJoin(axis(REGISTERS, "register")).crossJoin(formats)  # constants all


def rendered() -> Column:
    """The whole prompt from a row of the axes."""
    first = F.concat(F.lit("Jurisdiction: "), "place", F.lit(". Length: "), "length", F.lit(". Register: "), "register", F.lit("."))
    return F.concat_ws("\n", "head", first, F.concat(F.lit("Output format: "), "instruction"), F.lit(""), "tail", *[F.lit(r) for r in RULES])


def prompt_id(label: Column, prompt: Column) -> Column:
    return F.concat(F.lit(REGISTRY + ":"), label, F.lit(":"), F.substring(F.sha2(prompt, 256), 1, 16))
