"""Rule lists for reviews and routing, in the shapes that texts.risk_scan, texts.clause_conflicts, aggs.doc_type and texts.route_queries take.

They are examples to begin with: a table of the same columns can stand in for each (see risk_table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (rule, category, severity, requires, any_of): risks of a clause.
RISKS: list[tuple[str, str, str, list[str], list[str]]] = [
    ("one_sided_change", "balance", "high", [r"(?i)\b(?:supplier|provider|company|we)\b"], [r"(?i)\bvary (?:this|these|the) \w+ at any time\b", r"(?i)\bchange (?:this|these|the) \w+ without\b", r"(?i)\bsole discretion\b"]),
    ("one_sided_exit", "balance", "high", [r"(?i)\bterminat(?:e|ion)\b"], [r"(?i)\bfor any reason\b", r"(?i)\bimmediately\b", r"(?i)\bwithout cause\b"]),
    ("silent_renewal", "balance", "medium", [r"(?i)\brenew(?:s|al|ed)?\b"], [r"(?i)\bautomatic(?:ally)?\b", r"(?i)\bunless cancelled\b"]),
    ("default_charge", "balance", "medium", [r"(?i)\b(?:late|default|early exit) (?:fee|charge|payment)s?\b"], []),
    ("wide_restraint", "restraint", "medium", [r"(?i)\b(?:compet(?:e|ing)|solicit)\b"], [r"(?i)\bfor \d+ (?:month|year)s\b", r"(?i)\bworldwide\b", r"(?i)\bAustralia\b"]),
    ("guarantees_shut_out", "consumer", "high", [r"(?i)\b(?:warrant(?:y|ies)|guarantees?)\b", r"(?i)\b(?:exclude[sd]?|disclaim(?:s|ed)?|no refunds?)\b"], []),
    ("liability_limit", "liability", "medium", [r"(?i)\bliab(?:le|ility)\b", r"(?i)\b(?:limited to|not exceed|capped at)\b"], []),
    ("open_indemnity", "liability", "high", [r"(?i)\bindemnif(?:y|ies)\b|\bindemnity\b"], [r"(?i)\ball (?:loss|losses|claims|costs)\b", r"(?i)\bunlimited\b", r"(?i)\bhowever caused\b"]),
    ("personal_data_use", "privacy", "medium", [r"(?i)\bpersonal (?:data|information)\b", r"(?i)\b(?:collect|use|disclose|share)\b"], []),
    ("data_abroad", "privacy", "medium", [r"(?i)\b(?:data|information)\b", r"(?i)\b(?:overseas|offshore|outside Australia)\b"], []),
    ("contractor_label", "work", "high", [r"(?i)\bcontractor\b"], [r"(?i)\bno (?:leave|superannuation)\b", r"(?i)\bfixed hours\b", r"(?i)\bexclusively\b"]),
    ("work_without_pay", "work", "high", [r"(?i)\bunpaid\b"], [r"(?i)\btrial\b", r"(?i)\bovertime\b", r"(?i)\binternship\b"]),
    ("price_before_tax", "price", "low", [r"(?i)\b(?:price|fee|amount)s?\b", r"\bGST\b"], []),
    ("price_rise", "price", "medium", [r"(?i)\b(?:price|fee|charge)s?\b", r"(?i)\bincrease\b"], [r"(?i)\bat any time\b", r"(?i)\bwithout notice\b", r"(?i)\bdiscretion\b"]),
    ("cooling_off", "process", "low", [r"(?i)\bcooling[- ]off\b"], []),
    ("forum", "process", "low", [r"(?i)\bcourts of\b"], [r"(?i)\bexclusive jurisdiction\b", r"(?i)\bsubmit\b"]),
    ("rights_assigned", "ownership", "medium", [r"(?i)\bassign(?:s|ed)?\b", r"(?i)\b(?:intellectual property|copyright)\b"], []),
    ("secrecy_for_ever", "ownership", "medium", [r"(?i)\bconfidential\b"], [r"(?i)\bperpetual(?:ly)?\b", r"(?i)\bindefinitely\b", r"(?i)\bsurvives?\b"]),
]

#: (conflict, A, B): pairs of clauses that pull apart.
CONFLICTS: list[tuple[str, str, str]] = [
    ("notice and immediate exit", r"(?i)\b\d+ (?:days|weeks|months)['’]? (?:written )?notice\b", r"(?i)\bterminate immediately\b|\bwithout notice\b"),
    ("end date and renewal", r"(?i)\b(?:ends|expires) on\b", r"(?i)\brenews? automatically\b|\bautomatic(?:ally)? renew"),
    ("no liability and indemnity", r"(?i)\b(?:not be liable|no liability)\b", r"(?i)\bindemnif(?:y|ies)\b"),
    ("no warranty and kept rights", r"(?i)\bwarrant(?:y|ies) (?:is|are) excluded\b|\bno warrant(?:y|ies)\b", r"(?i)\bconsumer law\b|\bcannot be excluded\b"),
    ("exclusive and free to deal", r"(?i)\bexclusive (?:supplier|distributor|licence|agent)\b", r"(?i)\bmay (?:appoint|supply|engage) (?:others|third parties)\b"),
]

#: (type, pattern, weight): what tells the type of a document.
SIGNALS: list[tuple[str, str, int]] = [
    ("contract", r"(?i)\bthis agreement\b", 4), ("contract", r"(?i)\bthe parties\b", 2), ("contract", r"(?i)\bgoverning law\b", 2), ("contract", r"(?i)\btermination\b", 1),
    ("lease", r"(?i)\blandlord\b|\blessor\b", 4), ("lease", r"(?i)\btenant\b|\blessee\b", 3), ("lease", r"(?i)\brent\b", 1),
    ("employment", r"(?i)\bemployee\b", 3), ("employment", r"(?i)\bemployer\b", 2), ("employment", r"(?i)\bannual leave\b", 2),
    ("policy", r"(?i)\bthis policy\b", 4), ("policy", r"(?i)\bapplies to all\b", 2), ("policy", r"(?i)\bprivacy\b", 1),
    ("claim", r"(?i)\bstatement of claim\b", 6), ("claim", r"(?i)\bplaintiff\b", 2), ("claim", r"(?i)\bdefendant\b", 2),
    ("demand", r"(?i)\bletter of demand\b", 6), ("demand", r"(?i)\bamount owing\b", 2), ("demand", r"(?i)\bwithin \d+ days\b", 1),
]

#: (rule, priority, patterns, target, yields_to): the operator that a question goes to; the least priority wins.
ROUTES: list[tuple[str, int, list[str], str, tuple[str, ...]]] = [
    ("check_citations", 10, [r"(?i)\b(?:check|verify) (?:these|this|the|my) citations?\b", r"\[\d{4}\] [A-Z]\w+ \d+.*\bcorrect\b"], "verify_citations", ()),
    ("still_good_law", 12, [r"(?i)\bgood law\b", r"(?i)\boverruled\b"], "cite_check", ("check_citations",)),
    ("review_document", 15, [r"(?i)\breview (?:this|my|the) (?:contract|lease|agreement|document)\b"], "document_review", ()),
    ("at_a_date", 20, [r"(?i)\bas at\b", r"(?i)\bin force on\b", r"(?i)\bapplied in \d{4}\b"], "applicable_law", ("compare",)),
    ("compare", 22, [r"(?i)\bcompare\b", r"(?i)\bdifferences? between\b", r"(?i)\bwhat changed\b"], "compare_versions", ()),
    ("history", 25, [r"(?i)\bamendment history\b", r"(?i)\bwhen was .* (?:inserted|amended|repealed)\b"], "provision_history", ()),
    ("impact", 28, [r"(?i)\bimpact of\b", r"(?i)\baffected by\b"], "impact_map", ()),
    ("states", 30, [r"(?i)\bother states\b", r"(?i)\bstate equivalents?\b"], "state_counterparts", ()),
    ("instruments", 32, [r"(?i)\b(?:regulations|instruments) (?:under|made under)\b"], "enabled_instruments", ()),
    ("provision", 40, [r"(?i)\b(?:section|s|reg|regulation|clause|schedule) \d+[A-Z]*\b"], "slice_provision", ("at_a_date", "history", "impact")),
    ("meaning", 45, [r"(?i)\bwhat does .* mean\b", r"(?i)\bdefinition of\b"], "rank_terms", ()),
    ("cases", 50, [r"(?i)\b(?:cases?|decisions?|judgments?) (?:about|on|where)\b"], "citing_documents", ()),
    ("title", 60, [r"\b[A-Z]\w+ Act \d{4}\b"], "title_search", ("provision",)),
]


def risk_table(spark: SparkSession) -> DataFrame:
    """RISKS as a table: rule, category, severity, requires, any_of."""
    return spark.createDataFrame(RISKS, "rule string, category string, severity string, requires array<string>, any_of array<string>")
