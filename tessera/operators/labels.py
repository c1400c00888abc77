"""Clause types and the risk that each one stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The clause types of the labelled corpus by risk.
HIGH = [
    "Uncapped Liability", "Unlimited/All-You-Can-Eat-License", "Irrevocable Or Perpetual License", "Liquidated Damages", "Change Of Control",
    "Ip Ownership Assignment", "Joint Ip Ownership", "Source Code Escrow", "Non-Compete", "Exclusivity", "Competitive Restriction Exception",
    "No-Solicit Of Customers", "Most Favored Nation",
]
MEDIUM = [
    "Cap On Liability", "Minimum Commitment", "Revenue/Profit Sharing", "Price Restrictions", "Volume Restriction", "Insurance", "Audit Rights",
    "Anti-Assignment", "Termination For Convenience", "Post-Termination Services", "Rofr/Rofo/Rofn", "Covenant Not To Sue", "No-Solicit Of Employees",
    "Non-Disparagement", "Third Party Beneficiary", "License Grant", "Non-Transferable License", "Affiliate License-Licensee",
    "Affiliate License-Licensor", "Warranty Duration", "Governing Law",
]
LOW = ["Parties", "Document Name", "Agreement Date", "Effective Date", "Expiration Date", "Renewal Term", "Notice Period To Terminate Renewal"]
RISK = {**dict.fromkeys(HIGH, "high"), **dict.fromkeys(MEDIUM, "medium"), **dict.fromkeys(LOW, "low")}


def map_labels(clauses: DataFrame, risks: dict[str, str] = RISK) -> DataFrame:
    """``clauses`` with the ``risk`` of their ``clause_type``. A type that ``risks`` lacks, null
    too, is an error that names it as soon as its row is read: it needs a decision, not a
    default. The table is as small as the code that states it, so it goes to all tasks."""
    spark = clauses.sparkSession
    table = spark.createDataFrame(list(risks.items()), "clause_type string, risk string")
    j = clauses.drop("risk").join(F.broadcast(table), "clause_type", "left")
    unknown = F.raise_error(F.concat(F.lit("no risk for the clause type "), F.coalesce("clause_type", F.lit("null"))))
    return j.where(F.coalesce(F.col("risk"), unknown.cast("string")).isNotNull())


def unmapped(clauses: DataFrame, risks: dict[str, str] = RISK) -> DataFrame:
    """(clause_type, n) that ``map_labels`` would refuse."""
    own = F.coalesce(F.col("clause_type").isin(list(risks)), F.lit(False))
    return clauses.where(~own).groupBy("clause_type").agg(F.count("*").alias("n"))
