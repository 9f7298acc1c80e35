"""Closed vocabularies of the data model, and their frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Document types with category and form, in order.
DOCUMENT_TYPES = (
    ("acquisition_agreement", "transaction", "contract"),
    ("shareholders_agreement", "corporate", "contract"),
    ("commercial_agreement", "commercial", "contract"),
    ("employment_agreement", "employment", "contract"),
    ("lease_agreement", "property", "contract"),
    ("financing_agreement", "financial", "contract"),
    ("ip_agreement", "ip", "contract"),
    ("nda", "transaction", "contract"),
    ("insurance_policy", "insurance", "contract"),
    ("disclosure_schedule", "transaction", "contract"),
    ("constitutional", "corporate", "contract"),
    ("financial_statements", "financial", "statement"),
    ("financial_model", "financial", "statement"),
    ("tax_document", "financial", "statement"),
    ("cap_table", "corporate", "statement"),
    ("minutes", "corporate", "record"),
    ("certificate", "corporate", "record"),
    ("regulatory", "legal_regulatory", "record"),
    ("diligence_qa", "diligence", "record"),
    ("information_memorandum", "diligence", "report"),
    ("report", "diligence", "report"),
    ("litigation", "legal_regulatory", "report"),
    ("correspondence", "correspondence", "correspondence"),
    ("other", None, None),
    ("unknown", None, None),
    ("mixed_bundle", None, None),
)

# Clause types in model order; "unknown" is derived, never predicted.
CLAUSE_TYPES = (
    "Affiliate License-Licensee",
    "Affiliate License-Licensor",
    "Agreement Date",
    "Anti-Assignment",
    "Audit Rights",
    "Cap On Liability",
    "Change Of Control",
    "Competitive Restriction Exception",
    "Covenant Not To Sue",
    "Document Name",
    "Effective Date",
    "Exclusivity",
    "Expiration Date",
    "Governing Law",
    "Insurance",
    "Ip Ownership Assignment",
    "Irrevocable Or Perpetual License",
    "Joint Ip Ownership",
    "License Grant",
    "Liquidated Damages",
    "Minimum Commitment",
    "Most Favored Nation",
    "No-Solicit Of Customers",
    "No-Solicit Of Employees",
    "Non-Compete",
    "Non-Disparagement",
    "Non-Transferable License",
    "Notice Period To Terminate Renewal",
    "Parties",
    "Post-Termination Services",
    "Price Restrictions",
    "Renewal Term",
    "Revenue/Profit Sharing",
    "Rofr/Rofo/Rofn",
    "Source Code Escrow",
    "Termination For Convenience",
    "Third Party Beneficiary",
    "Uncapped Liability",
    "Unlimited/All-You-Can-Eat-License",
    "Volume Restriction",
    "Warranty Duration",
)
UNKNOWN = "unknown"
# Types that describe a document, those that reviews ask for, and the
# name of this list of labels.
METADATA_TYPES = ("Document Name", "Parties", "Agreement Date", "Effective Date", "Expiration Date")
CRITICAL_TYPES = ("Governing Law", "Change Of Control", "Termination For Convenience", "Cap On Liability", "Anti-Assignment")
LABEL_SCHEMA = "cuad41-derived-other-v1"

# Keyword to clause type.
KEYWORDS = (
    ("governing law", "Governing Law"),
    ("insurance", "Insurance"),
    ("audit", "Audit Rights"),
    ("change of control", "Change Of Control"),
    ("change in control", "Change Of Control"),
    ("non-compete", "Non-Compete"),
    ("not to compete", "Non-Compete"),
    ("exclusiv", "Exclusivity"),
    ("renew", "Renewal Term"),
    ("effective date", "Effective Date"),
    ("expiration", "Expiration Date"),
    ("assign", "Anti-Assignment"),
    ("license", "License Grant"),
    ("warrant", "Warranty Duration"),
    ("minimum", "Minimum Commitment"),
    ("most favored", "Most Favored Nation"),
    ("solicit", "No-Solicit Of Employees"),
    ("disparage", "Non-Disparagement"),
    ("escrow", "Source Code Escrow"),
    ("by and between", "Parties"),
    ("for convenience", "Termination For Convenience"),
)

# Provision labels of another corpus that have a clause type here.
PROVISION_LABELS = (
    ("Change In Control", "Change Of Control"),
    ("Governing Laws", "Governing Law"),
    ("Effective Dates", "Effective Date"),
    ("Non-Disparagement", "Non-Disparagement"),
    ("Insurances", "Insurance"),
)

# Document types with a planned real evaluation, then those without.
PILOT_TYPES = (
    "acquisition_agreement",
    "commercial_agreement",
    "ip_agreement",
    "employment_agreement",
    "nda",
    "financing_agreement",
    "constitutional",
    "shareholders_agreement",
)
EXPERIMENTAL_TYPES = (
    "financial_statements",
    "financial_model",
    "cap_table",
    "tax_document",
    "minutes",
    "certificate",
    "regulatory",
    "litigation",
    "report",
    "information_memorandum",
    "disclosure_schedule",
    "correspondence",
    "insurance_policy",
    "lease_agreement",
    "diligence_qa",
)
MODEL_LABELS = (*PILOT_TYPES, *EXPERIMENTAL_TYPES, "other")

# Enumerations of the data model.
BLOCK_TYPES = ("paragraph", "heading", "list_item", "table", "page_header", "page_footer", "caption", "other")
CLAUSE_ROLES = ("article", "section", "subclause", "region")
ENTITY_TYPES = ("party", "person", "org", "date", "money", "percent", "duration", "jurisdiction", "governing_law", "location", "other")
SPLITS = ("train", "real_adaptation", "real_dev", "real_test")


def check_vocabularies() -> None:
    """Fail on drift between the lists above."""
    leaves = {t for t, category, _ in DOCUMENT_TYPES if category}
    if leaves != set(PILOT_TYPES) | set(EXPERIMENTAL_TYPES) or set(PILOT_TYPES) & set(EXPERIMENTAL_TYPES):
        raise ValueError("document types and model labels differ")
    if len(set(CLAUSE_TYPES)) != 41 or not set(METADATA_TYPES) | set(CRITICAL_TYPES) <= set(CLAUSE_TYPES):
        raise ValueError("clause types differ")


def frame(spark: SparkSession, rows: list | tuple, columns: str) -> DataFrame:
    """A small constant relation from one literal. columns: "name kind, ..."."""
    names = [c.split()[0] for c in columns.split(", ")]
    told = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(told), f"array<struct<{kind}>>")))


def document_types(spark: SparkSession) -> DataFrame:
    return frame(spark, DOCUMENT_TYPES, "document_type string, category string, form string")


def clause_types(spark: SparkSession) -> DataFrame:
    """clause_type, idx and category (null for unknown)."""
    rows = [(t, i, "metadata" if t in METADATA_TYPES else "provision") for i, t in enumerate(CLAUSE_TYPES)]
    return frame(spark, [*rows, (UNKNOWN, len(rows), None)], "clause_type string, idx int, category string")
