"""Clause taxonomy: names, metadata subset, risk lists, question keys, descriptions."""

# --- fixed values: the 41 clause names, in order -----------------------------------
CLAUSES = [
    "Document Name", "Parties", "Agreement Date", "Effective Date", "Expiration Date",
    "Renewal Term", "Notice Period To Terminate Renewal", "Governing Law",
    "Most Favored Nation", "Non-Compete", "Exclusivity", "No-Solicit Of Customers",
    "No-Solicit Of Employees", "Non-Disparagement", "Termination For Convenience",
    "ROFR/ROFO/ROFN", "Change Of Control", "Anti-Assignment", "Revenue/Profit Sharing",
    "Price Restrictions", "Minimum Commitment", "Volume Restriction",
    "IP Ownership Assignment", "Joint IP Ownership", "License Grant",
    "Non-Transferable License", "Affiliate License-Licensor", "Affiliate License-Licensee",
    "Unlimited/All-You-Can-Eat-License", "Irrevocable Or Perpetual License",
    "Source Code Escrow", "Post-Termination Services", "Audit Rights",
    "Uncapped Liability", "Cap On Liability", "Liquidated Damages", "Warranty Duration",
    "Insurance", "Covenant Not To Sue", "Third Party Beneficiary", "Indemnification",
]

# --- fixed values: metadata clauses, never modelled --------------------------------
METADATA_CLAUSES = [
    "Document Name", "Parties", "Agreement Date", "Effective Date", "Expiration Date",
]

# --- fixed values: risk lists. Several versions exist; a version is always named ---
RISK_VERSIONS = {
    "production": {
        "HIGH": [
            "Uncapped Liability", "IP Ownership Assignment", "Change Of Control",
            "Non-Compete", "Liquidated Damages", "Joint IP Ownership",
        ],
        "MEDIUM": [
            "Indemnification", "Cap On Liability", "Termination For Convenience",
            "Exclusivity", "No-Solicit Of Employees", "No-Solicit Of Customers",
            "Revenue/Profit Sharing", "Most Favored Nation", "Covenant Not To Sue",
        ],
    },
    "first_pipeline": {
        "HIGH": [
            "Uncapped Liability", "IP Ownership Assignment", "Change Of Control",
            "Non-Compete", "Liquidated Damages", "Joint IP Ownership",
        ],
        "MEDIUM": [
            "Indemnification", "Cap On Liability", "Termination For Convenience",
            "Exclusivity", "No-Solicit Of Employees", "No-Solicit Of Customers",
            "Revenue/Profit Sharing",
        ],
    },
    "configuration": {
        "HIGH": [
            "Uncapped Liability", "IP Ownership Assignment", "Change of Control",
            "Non-Compete", "Liquidated Damages",
        ],
        "MEDIUM": [
            "Indemnification", "Limitation of Liability", "Termination for Convenience",
            "Exclusivity", "No-Solicit of Employees",
        ],
    },
    "review_screen": {
        "HIGH": [
            "Uncapped Liability", "Change Of Control", "Non-Compete", "Liquidated Damages",
        ],
        "MEDIUM": [
            "Indemnification", "Cap On Liability", "Termination For Convenience",
            "Exclusivity", "No-Solicit Of Employees", "No-Solicit Of Customers",
            "Revenue/Profit Sharing",
        ],
    },
}

# --- fixed values: key phrase in a question -> clause; the first key in order wins --
QUESTION_KEYS = [
    ("document name", "Document Name"),
    ("parties", "Parties"),
    ("agreement date", "Agreement Date"),
    ("effective date", "Effective Date"),
    ("expiration date", "Expiration Date"),
    ("renewal term", "Renewal Term"),
    ("notice period to terminate renewal", "Notice Period To Terminate Renewal"),
    ("governing law", "Governing Law"),
    ("most favored nation", "Most Favored Nation"),
    ("non-compete", "Non-Compete"),
    ("exclusivity", "Exclusivity"),
    ("no-solicit of customers", "No-Solicit Of Customers"),
    ("no-solicit of employees", "No-Solicit Of Employees"),
    ("non-disparagement", "Non-Disparagement"),
    ("termination for convenience", "Termination For Convenience"),
    ("rofr", "ROFR/ROFO/ROFN"),
    ("rofo", "ROFR/ROFO/ROFN"),
    ("rofn", "ROFR/ROFO/ROFN"),
    ("change of control", "Change Of Control"),
    ("anti-assignment", "Anti-Assignment"),
    ("revenue/profit sharing", "Revenue/Profit Sharing"),
    ("price restrictions", "Price Restrictions"),
    ("minimum commitment", "Minimum Commitment"),
    ("volume restriction", "Volume Restriction"),
    ("ip ownership assignment", "IP Ownership Assignment"),
    ("joint ip ownership", "Joint IP Ownership"),
    ("license grant", "License Grant"),
    ("non-transferable license", "Non-Transferable License"),
    ("affiliate license-licensor", "Affiliate License-Licensor"),
    ("affiliate license-licensee", "Affiliate License-Licensee"),
    ("unlimited/all-you-can-eat", "Unlimited/All-You-Can-Eat-License"),
    ("irrevocable or perpetual license", "Irrevocable Or Perpetual License"),
    ("source code escrow", "Source Code Escrow"),
    ("post-termination services", "Post-Termination Services"),
    ("audit rights", "Audit Rights"),
    ("uncapped liability", "Uncapped Liability"),
    ("cap on liability", "Cap On Liability"),
    ("liquidated damages", "Liquidated Damages"),
    ("warranty duration", "Warranty Duration"),
    ("insurance", "Insurance"),
    ("covenant not to sue", "Covenant Not To Sue"),
    ("third party beneficiary", "Third Party Beneficiary"),
    ("indemnification", "Indemnification"),
]

# --- fixed values: one-line descriptions shown next to a clause ---------------------
CLAUSE_DESCRIPTIONS = {
    "Uncapped Liability": "No cap on damages — vendor/party can be liable for unlimited amounts.",
    "Change Of Control": "Rights/obligations triggered by merger, acquisition, or ownership change.",
    "Non-Compete": "Restriction on competing business activities within defined scope/duration.",
    "Liquidated Damages": "Pre-specified penalty amount payable upon breach.",
    "Indemnification": "Obligation to compensate for losses, damages, or expenses.",
    "Cap On Liability": "Maximum aggregate liability set for breach of contract.",
    "Termination For Convenience": "Right to terminate without cause (unilateral exit).",
    "Exclusivity": "Restriction on working with competitors during contract term.",
    "No-Solicit Of Employees": "Prohibition on recruiting or hiring the other party's staff.",
    "No-Solicit Of Customers": "Prohibition on soliciting the other party's customer base.",
    "IP Ownership Assignment": "Transfer of IP rights created under the agreement.",
    "Joint IP Ownership": "Both parties share ownership of jointly created IP.",
    "Revenue/Profit Sharing": "Formula for splitting revenues or profits between parties.",
    "Governing Law": "Jurisdiction whose laws govern the contract.",
    "Audit Rights": "Right to audit the other party's records and compliance.",
    "Insurance": "Required insurance coverage during the contract term.",
    "Warranty Duration": "Period during which warranty obligations apply.",
    "Renewal Term": "Automatic or optional renewal conditions.",
    "Anti-Assignment": "Restrictions on transferring contract rights to third parties.",
}

# --- fixed values: the eight sentence-level unfair-term labels, in id order ---------
UNFAIR_TERM_LABELS = [
    "Limitation of liability", "Unilateral termination", "Unilateral change",
    "Content removal", "Contract by using", "Choice of law", "Jurisdiction", "Arbitration",
]

# --- fixed values: risk weights of the documented 0-100 score -----------------------
RISK_WEIGHTS = {"HIGH": 10, "MEDIUM": 4, "LOW": 1}
RISK_SCORE_CAP = 100
