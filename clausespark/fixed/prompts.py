"""Prompt templates, answer keys and prices of the question-answering comparison."""

# --- fixed values: answer key in a reply -> clause name -----------------------------
ANSWER_KEYS = [
    ("Uncapped Liability", "Uncapped Liability"),
    ("Change of Control", "Change Of Control"),
    ("Non-Compete", "Non-Compete"),
    ("Liquidated Damages", "Liquidated Damages"),
]

# --- fixed values: suffixes put behind a shortened text -----------------------------
SHORT_SUFFIX = " [... contract continues ...]"
LONG_SUFFIX = "\n[... contract continues ...]"

# --- fixed values: prompt texts; {text} marks the place of the excerpt --------------
ZERO_SHOT_TEMPLATE = (
    "You are a legal expert. Analyze the following contract excerpt and identify "
    "which HIGH-RISK clause types are present. For each, answer YES or NO.\n\n"
    "1. Uncapped Liability: liability NOT capped or limited (no maximum for damages)\n"
    "2. Change of Control: provisions triggered by ownership/control changes\n"
    "3. Non-Compete: restrictions on competitive activities\n"
    "4. Liquidated Damages: pre-agreed fixed damage amounts upon breach\n\n"
    "CONTRACT:\n{text}\n\n"
    "Respond ONLY in this exact format:\n"
    "Uncapped Liability: YES/NO\nChange of Control: YES/NO\n"
    "Non-Compete: YES/NO\nLiquidated Damages: YES/NO"
)
FEW_SHOT_TEMPLATE = (
    "You are a legal expert. Analyze contracts for HIGH-RISK clauses.\n\n"
    "EXAMPLES:\n"
    "Ex1: 'The total liability shall be unlimited...' -> Uncapped Liability: YES\n"
    "Ex2: 'In event of Change of Control (>50% share transfer), Customer may terminate...' "
    "-> Change of Control: YES\n"
    "Ex3: 'Vendor shall pay $5,000 per day of delay as liquidated damages...' "
    "-> Liquidated Damages: YES\n"
    "Ex4: 'Neither party shall compete with the other for 3 years post-termination...' "
    "-> Non-Compete: YES\n\n"
    "CONTRACT:\n{text}\n\n"
    "Respond ONLY in this exact format:\n"
    "Uncapped Liability: YES/NO\nChange of Control: YES/NO\n"
    "Non-Compete: YES/NO\nLiquidated Damages: YES/NO"
)

# --- fixed values: the long prompts, for texts of up to LONG_WORDS words ---------------
LONG_WORDS = 3_500
LONG_ZERO_SHOT_TEMPLATE = """You are a legal expert specializing in contract risk analysis.
Analyze the following contract and identify whether each of these HIGH-RISK clause types is present.

For each clause type, answer YES if the clause is clearly present, or NO if it is absent or unclear.

HIGH-RISK clause definitions:
1. Uncapped Liability: A clause where one party's liability for damages or indemnification is NOT subject to any cap, limit, or maximum amount. Phrases like "unlimited liability", no "liability shall not exceed", or explicit exclusions of liability caps.
2. Change of Control: A provision that is triggered by, or grants rights related to, a change in ownership, control, or majority shareholder of a party. Look for "change of control", "acquisition", "merger", "change in ownership" provisions.
3. Non-Compete: A restriction that prohibits one party from engaging in competitive activities, working for competitors, or soliciting the other party's customers/employees for a defined period or territory.
4. Liquidated Damages: A clause that pre-specifies a fixed or formula-based damage amount payable upon breach, rather than actual damages. Look for "liquidated damages", "penalty", pre-agreed damage amounts.

CONTRACT TEXT:
{text}

Respond ONLY in this exact format (nothing else):
Uncapped Liability: YES/NO
Change of Control: YES/NO
Non-Compete: YES/NO
Liquidated Damages: YES/NO"""
LONG_EXAMPLES = """
EXAMPLE 1:
Contract excerpt: "...The total liability of either party under this Agreement shall be unlimited and shall include all direct, indirect, incidental, and consequential damages...The Company shall not engage in any business activities that compete directly or indirectly with Acme Corp's core products for a period of 3 years following termination..."
Uncapped Liability: YES
Change of Control: NO
Non-Compete: YES
Liquidated Damages: NO

EXAMPLE 2:
Contract excerpt: "...In the event of a Change of Control of Vendor (defined as any acquisition, merger, or transfer of more than 50% of Vendor's voting shares), Customer may terminate this Agreement with 30 days notice...In case of late delivery, Vendor shall pay liquidated damages of $5,000 per calendar day of delay, not to exceed $500,000..."
Uncapped Liability: NO
Change of Control: YES
Non-Compete: NO
Liquidated Damages: YES

EXAMPLE 3:
Contract excerpt: "...Either party's aggregate liability shall not exceed the total fees paid in the 12 months prior to the claim...The terms of this Agreement shall survive any corporate reorganization..."
Uncapped Liability: NO
Change of Control: NO
Non-Compete: NO
Liquidated Damages: NO
"""
LONG_FEW_SHOT_TEMPLATE = """You are a legal expert specializing in contract risk analysis.
Below are examples of correctly identified HIGH-RISK clauses, followed by a new contract to analyze.

{examples}

Now analyze the following contract:

HIGH-RISK clause definitions:
1. Uncapped Liability: A clause where one party's liability is NOT subject to any cap or maximum.
2. Change of Control: A provision triggered by ownership/control changes of a party.
3. Non-Compete: A restriction prohibiting competitive activities for a period/territory.
4. Liquidated Damages: A pre-specified fixed damage amount payable upon breach.

CONTRACT TEXT:
{text}

Respond ONLY in this exact format (nothing else):
Uncapped Liability: YES/NO
Change of Control: YES/NO
Non-Compete: YES/NO
Liquidated Damages: YES/NO"""

# --- fixed values: price in dollars per million tokens ------------------------------
INPUT_PRICE_PER_MILLION = 3.0
OUTPUT_PRICE_PER_MILLION = 15.0
