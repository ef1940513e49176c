"""Thresholds and word lists, in one frozen object. Values that are ours are named as defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Our defaults: similarity bands and margins.
    matched: float = 0.98
    variation_floor: float = 0.65
    semantic_floor: float = 0.65
    margin: float = 0.02
    # Limits of chunking, retrieval and evaluation.
    chunk_max: int = 1000
    text_chunk_max: int = 4000
    window_chars: int = 2500
    window_overlap: int = 250
    windows_most: int = 8
    retrieval_per_query: int = 5
    retrieval_distance: float = 0.5
    retrieval_final: int = 10
    library_distance: float = 0.6
    payload_tokens: int = 20_000
    amber_weight: float = 0.4
    # Dirty pages.
    page_least: int = 60
    glued_most: float = 0.06
    junk_most: float = 0.12
    # Names that stand for a heading that was not found.
    fallback_headings: tuple[str, ...] = ("Unstructured Extract", "Extraction Failed (Partial)", "Raw Text", "Extracted Text", "Main Text")
    # Headings that are labels of fields, their ends, references, parties and fields.
    label_headings: tuple[str, ...] = (
        "introduction", "contract details", "risk details", "client information", "agreement information", "contract administration", "agreement number",
        "order hereon", "unique market reference", "umr",
    )
    label_ends: tuple[str, ...] = ("short name", "shortname", "long name", "longname", "document date")
    label_references: tuple[str, ...] = ("previous", "client", "reinsured", "broker", "cedant", "cedent")
    label_parties: tuple[str, ...] = ("client", "reinsured", "cedant", "cedent", "broker", "insured")
    label_fields: tuple[str, ...] = ("name", "number", "code", "contact")
    currencies: tuple[str, ...] = ("usd", "gbp", "eur", "aud", "cad", "chf", "jpy", "sgd", "hkd")
    prose_words: tuple[str, ...] = (
        "shall", "will", "agree", "agrees", "hereby", "means", "include", "includes", "being", "other than", "cover", "covers", "covering", "which", "that", "where", "including",
    )
    # Lines that are noise as a whole, by their start, or by what they hold. Names of firms are for users to add.
    noise_lines: tuple[str, ...] = ("confidential", "information page", "unique market reference", "umr", "type")
    noise_starts: tuple[str, ...] = (
        "(c) 1", "(c) 2", "ocr error", "[ocr error", "registration no.", "market reform contract", "risk details section", "unique market", "taxes payable", "security details",
        "subscription agreement", "fiscal and regulatory", "broker remuneration", "basis of written", "basis of agreement", "client requirement", "policy number", "expiring policy",
        "claims agreement",
    )
    noise_contains: tuple[str, ...] = ("registered office:", "registered number")
    # First words of headings, of those in layouts, and of those that are never noise.
    heading_words: tuple[str, ...] = ("article", "section", "clause", "schedule", "annex", "appendix", "part")
    heading_verbs: tuple[str, ...] = ("shall", "will", "agrees", "between", "hereby")
    layout_starts: tuple[str, ...] = (
        "article", "section", "clause", "provision", "item", "schedule", "annex", "appendix", "risk details", "subscription agreement", "information page", "fiscal and regulatory",
        "security details", "broker remuneration", "premium", "conditions", "period", "class of business", "limits", "unique market", "reinsured", "type",
    )
    layout_vetoes: tuple[str, ...] = ("agrees", "shall", "will", "hereby", "between", "referred", "witnesseth", "if applicable", "with the terms")
    layout_types: tuple[str, ...] = ("heading", "header", "title", "article_number", "section_number")
    structural_words: tuple[str, ...] = ("article", "section", "part", "schedule", "appendix", "annex", "annexure", "exhibit", "endorsement")
    connecting_words: tuple[str, ...] = ("AND", "OR", "OF", "BY", "TO", "THE", "FOR", "WITH", "FROM", "PAYABLE", "ADMINISTERED", "IN")
    code_pattern: str = r"\b[A-Z]{2,4}\s?[0-9]{2,4}[A-Z]?\b"


DEFAULT = Config()
