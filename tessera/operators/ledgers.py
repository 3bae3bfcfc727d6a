"""Ledgers of moves between accounts: balances over time and an audit of every move by the rules of the accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import slices

#: Amounts are exact, to a millionth.
MONEY = "decimal(38,6)"


def entries(moves: DataFrame, seq: str, source: str, target: str, amount: str) -> DataFrame:
    """(seq, account, change): what each move takes from its source and gives to its target; null amounts are none."""
    value = F.coalesce(F.col(amount).cast(MONEY), F.lit(0).cast(MONEY))
    sides = F.array(F.struct(F.col(source).alias("account"), (-value).cast(MONEY).alias("change")), F.struct(F.col(target).alias("account"), value.alias("change")))
    return moves.select(F.col(seq).alias("seq"), F.explode(sides).alias("e")).select("seq", "e.*")


def balances(moves: DataFrame, seq: str, source: str, target: str, amount: str) -> DataFrame:
    """(account, balance, n): the balance of each account after all moves, and how many entries it has; partial sums only."""
    return entries(moves, seq, source, target, amount).groupBy("account").agg(F.sum("change").cast(MONEY).alias("balance"), F.count("*").alias("n"))


def statement(moves: DataFrame, seq: str, source: str, target: str, amount: str, opening: DataFrame | None = None, rows: int = slices.SLICE_ROWS) -> DataFrame:
    """(seq, account, change, balance): each entry with its account's balance behind it. seq is a whole number and orders the moves;
    of a move from an account to itself the taking comes first.

    opening (account, balance) is where accounts begin; others begin at 0. An account of very many moves is cut into slices of seq.
    """
    all_ = entries(moves, seq, source, target, amount)
    run = slices.running_total(all_, ["account"], ["seq", "change"], F.col("seq"), F.col("change"), "balance", rows)
    if opening is not None:
        start = opening.select(F.col("account").alias("_a"), F.col("balance").cast(MONEY).alias("_o"))
        run = run.join(start, F.col("account").eqNullSafe(F.col("_a")), "left").withColumn("balance", F.col("balance") + F.coalesce("_o", F.lit(0).cast(MONEY)))
    return run.select("seq", "account", "change", F.col("balance").cast(MONEY).alias("balance"))


def audit(moves: DataFrame, seq: str, source: str, target: str, amounts: dict[str, tuple[list, float | None]], opening: dict[str, DataFrame] | None = None, rows: int = slices.SLICE_ROWS) -> DataFrame:
    """(seq, faults): the moves that break a rule, with the names of the rules in order; all moves are taken to have been made.

    amounts maps each currency's column to the accounts that may go below 0 and to the most that an account may hold after it
    receives (None: any). Rules: same_account; no_amount, if all amounts are null or 0; not_positive, if one is below 0; and for each currency
    insufficient_<column>, if the source's balance was less than the amount when it was taken; unrealistic_<column>, if the target's went over the most.
    """
    value = lambda c: F.coalesce(F.col(c).cast(MONEY), F.lit(0).cast(MONEY))
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    plain = [("same_account", F.col(source).eqNullSafe(F.col(target))), ("no_amount", ~any_of([value(c) != 0 for c in amounts])), ("not_positive", any_of([value(c) < 0 for c in amounts]))]
    # the order of the rules in the result
    found = [moves.select(F.col(seq).alias("seq"), F.explode(F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("at"), F.lit(name).alias("fault"))) for i, (name, test) in enumerate(plain)]))).alias("f"))]
    for i, (c, (free, most)) in enumerate(amounts.items()):
        own = moves.where(value(c) > 0)
        lines = statement(own, seq, source, target, c, (opening or {}).get(c), rows)
        may: Column = F.col("account").isin(free) if free else F.lit(False)
        short = lines.where((F.col("change") < 0) & (F.col("balance") < 0) & ~F.coalesce(may, F.lit(False)))
        found.append(short.select("seq", F.struct(F.lit(3 + 2 * i).alias("at"), F.lit(f"insufficient_{c}").alias("fault")).alias("f")))
        if most is not None:
            over = lines.where((F.col("change") > 0) & (F.col("balance") > F.lit(most).cast(MONEY)))
            found.append(over.select("seq", F.struct(F.lit(4 + 2 * i).alias("at"), F.lit(f"unrealistic_{c}").alias("fault")).alias("f")))
    return reduce(DataFrame.unionByName, found).groupBy("seq").agg(F.sort_array(F.collect_set("f")).alias("f")).select("seq", F.transform("f", lambda x: x["fault"]).alias("faults"))


def checked(accounts: DataFrame, *parts: str) -> DataFrame:
    """One row (total, balanced): the sum of these balances over all accounts, which has to be 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast(MONEY), F.lit(0).cast(MONEY)) for c in parts])
    return accounts.agg(F.coalesce(F.sum(total), F.lit(0)).cast(MONEY).alias("total")).withColumn("balanced", F.col("total") == 0)
