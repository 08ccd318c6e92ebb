"""Outcome rules and story fields of the public logs the library is used with."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracewright.functions.narrative import Field, Narrative
from tracewright.operators.outcomes import (
    AmountCovered, ClosedNotReopened, Contains, ContainsNone, ContainsWithout, EndsWith,
    FlagOrDuration, Lookup, NoReturnWithin, NumericPositive, Rule,
)

# Log names used for corpora and for evaluation.
CORPUS_DATASETS = [
    "BPIC2013I", "BPIC2013O", "BPIC2019", "BPIC2020D", "BPIC2020I", "BPIC2020Pe",
    "BPIC2020Pr", "BPIC2012A", "BPIC2012O", "Receipt", "Sepsis", "Road_Traffic_Fine",
    "Service-process",
]
EVALUATION_DATASETS = [
    "BPIC2013C", "BPIC2017O", "BPIC2020R", "BPIC2012W", "Hospital-billing", "Helpdesk",
]

# The usual limits of a story corpus and of instruction data.
CORPUS_LIMITS = {"target": 8000, "per_variant": 64}
INSTRUCTION_LIMITS = {"max_cases": 1500, "prefixes_per_case": 6, "max_prefixes": 8000}

# Activities of the permit-receipt log that mean hold, stop or
# unlicensed, first in raw, then in canonical spelling.
RECEIPT_BRANCHES = [
    "t07-3 draft intern advice hold for aspect 3",
    "t07-4 draft internal advice to hold for type 4",
    "t08 draft and send request for advice",
    "t10 determine necessity to stop indication",
    "t11 create document x request unlicensed",
    "t12 check document x request unlicensed",
    "t13 adjust document x request unlicensed",
    "t14 determine document x request unlicensed",
    "t15 print document x request unlicensed",
    "t16 report reasons to hold request",
    "t17 check report y to stop indication",
    "t18 adjust report y to stop indicition",
    "t19 determine report y to stop indication",
    "t20 print report y to stop indication",
    "draft internal advice aspect 3",
    "draft internal advice aspect 4",
    "send advice request",
    "determine stop indication need",
    "create unlicensed request document",
    "check unlicensed request document",
    "adjust unlicensed request document",
    "determine unlicensed request document",
    "print unlicensed request document",
    "report hold reasons",
    "check stop indication report",
    "adjust stop indication report",
    "determine stop indication report",
    "print stop indication report",
]
# Releases of the sepsis log, in raw, then in canonical spelling.
RELEASES = [
    "release a", "release b", "release c", "release d", "release e",
    "release patient a", "release patient b", "release patient c", "release patient d", "release patient e",
]


def outcome_rules(application_labels: DataFrame | None = None) -> dict[str, Rule]:
    """Rule per public log; ``application_labels`` (case_id, value) feeds BPIC2012W."""
    # Rule texts, activity names and column names per log.
    paid = Contains("the case contains handle payment", ["handle payment", "payment handled"])
    accepted = ["accept application", "accept offer", "accepted"]
    closed = ["complete incident", "complete problem", "complete case", "completed"]
    billed = ["finalize bill", "issue bill", "release bill", "delete billing record",
              "set bill status", "set billing status"]
    rules: dict[str, Rule] = {
        "BPIC2013I": EndsWith("the case finishes with complete incident", closed),
        "BPIC2013O": EndsWith("the case finishes with complete problem", closed),
        "BPIC2013C": EndsWith("the case finishes with complete problem", closed),
        "BPIC2017O": Contains("the case contains accept offer", ["accept offer", "o_accepted"]),
        "BPIC2019": Contains("the case contains clear invoice", ["clear invoice"]),
        "BPIC2020D": paid, "BPIC2020I": paid, "BPIC2020Pe": paid,
        "BPIC2020Pr": paid, "BPIC2020R": paid,
        "BPIC2012A": Contains("the case contains accept application", accepted),
        "BPIC2012O": Contains("the case contains accept offer", accepted),
        "Hospital-billing": ClosedNotReopened(
            "the case is finalized or issued and never reopened",
            flag=["isClosed", "is_closed", "closed"],
            last_in=[*billed, "fin", "billed", "release", "delete", "set status"],
            any_of=billed,
            reopened=["reopen bill", "reopen"],
        ),
        "Receipt": ContainsNone(
            "the case never enters hold, stop, or unlicensed branches", RECEIPT_BRANCHES
        ),
        "Sepsis": NoReturnWithin(
            "the patient does not return to emergency within 28 days after release",
            release=RELEASES,
            returned=["return er", "return to emergency", "return patient to emergency"],
            days=28.0,
        ),
        "Helpdesk": ContainsWithout(
            "the ticket is closed and never marked duplicate or invalid",
            acts=["closed", "close ticket"],
            bad=["duplicate", "mark duplicate ticket", "invalid", "mark invalid ticket"],
        ),
        "Production": NumericPositive(
            "the rejected quantity is zero for the whole case",
            column=["Qty_Rejected", "Qty Rejected", "rejected qty"], keywords=["rework", "reject"],
        ),
        "Road_Traffic_Fine": AmountCovered(
            "the fine is paid and never sent for debt collection",
            amount=["amount"], paid=["total", "payment", "amount"],
            payment=["payment", "receive payment"],
            collected=["send for credit collection", "send for debt collection",
                       "send case for debt collection"],
        ),
        "Service-process": FlagOrDuration(
            "REPAIR_IN_TIME_5D is true",
            flag="REPAIR_IN_TIME_5D", completed=["complete service order", "completed"], days=5.0,
        ),
    }
    if application_labels is not None:
        rules["BPIC2012W"] = Lookup(
            "the same case is accepted in BPIC2012A", labels=application_labels
        )
    return rules


def narratives() -> dict[str, Narrative]:
    """Introduction, case fields and event fields per public log."""
    impact = Field(["impact"], "the impact is {value}", lower=True)
    country = Field(["resource country", "organization country"], "the handling country is {value}")
    transition = Field(["lifecycle:transition"], "transition {value}", lower=True)
    role = Field(["org:role"], "role {value}", lower=True)
    resource = Field(["org:resource"], "resource {value}", lower=True)
    # Texts and column names per log.
    return {
        "BPIC2013I": Narrative("This is an incident management case.", [impact, country], [transition]),
        "BPIC2013O": Narrative("This is a problem management case.", [impact, country], [transition]),
        "BPIC2013C": Narrative("This is a problem management case.", [impact, country], [transition]),
        "BPIC2019": Narrative("This is a purchase order handling case.", [
            Field(["case:Spend area text"], "the spend area is {value}"),
            Field(["case:Sub spend area text"], "the sub spend area is {value}"),
            Field(["Cumulative net worth (EUR)"], "the net worth is {value} EUR"),
            Field(["case:Item Type"], "the item type is {value}", lower=True),
            Field(["case:Item Category"], "the item category is {value}", lower=True),
            Field(["case:GR-Based Inv. Verif."],
                  true="GR-based invoice verification is enabled",
                  false="GR-based invoice verification is disabled"),
        ]),
        "BPIC2020D": Narrative("This is a domestic travel declaration case.", [], [role, resource]),
        "BPIC2020I": Narrative("This is an international travel declaration case.", [], [role, resource]),
        "BPIC2020Pe": Narrative("This is a travel permit case.", [
            Field(["case:Overspent"], true="the case is overspent", false="the case is not overspent"),
        ], [role, resource]),
        "BPIC2020Pr": Narrative("This is a payment request case.", [], [role, resource]),
        "BPIC2020R": Narrative("This is a payment request case.", [], [role, resource]),
        "BPIC2012A": Narrative("This is a loan application case.", [], [transition]),
        "BPIC2012O": Narrative("This is an offer handling case.", [], [transition]),
        "BPIC2012W": Narrative("This is a loan application case.", [], [transition]),
        "BPIC2017O": Narrative("This is an offer handling case.", [
            Field(["MonthlyCost"], "the monthly cost is {value}"),
            Field(["NumberOfTerms"], "the number of terms is {value}"),
            Field(["CreditScore"], "the credit score is {value}"),
        ], [Field(["action"], "action {value}", lower=True)]),
        "Receipt": Narrative("This is a building permit receipt case.", [
            Field(["case:channel", "channel"], "the submission channel is {value}", lower=True),
        ]),
        "Sepsis": Narrative("This is a hospital sepsis case.", [
            Field(["Diagnose"], "the diagnosis is {value}"),
            Field(["Age"], "the age is {value}"),
            Field(["nfectionSuspected", "InfectionSuspected"],
                  true="infection is suspected", false="infection is not suspected"),
            Field(["Hypotensie"],
                  true="hypotension is present", false="hypotension is not present"),
        ]),
        "Road_Traffic_Fine": Narrative("This is a road traffic fine case."),
        "Service-process": Narrative("This is a device repair service case."),
        "Hospital-billing": Narrative("This is a hospital billing case."),
        "Helpdesk": Narrative("This is a helpdesk ticket case.", [
            Field(["responsiblesection"], "the responsible section is {value}", lower=True),
            Field(["supportsection"], "the support section is {value}", lower=True),
        ]),
    }
