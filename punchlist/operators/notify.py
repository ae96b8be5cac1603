"""Faults, notes and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import normal_message
from .pairs import all_pairs


def faults(reports: DataFrame, message: str, at: str) -> DataFrame:
    """Reports of one fault together: how often, first and last seen. The code is a prefix of the fingerprint."""
    shape = normal_message(F.col(message))
    return (
        reports.select(shape.alias("shape"), F.col(at).alias("_t"))
        .groupBy("shape")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("first_seen"), F.max("_t").alias("last_seen"))
        .withColumn("fingerprint", F.substring(F.sha2("shape", 256), 1, 12))
    )


def notify_due(last_notified: Column, now: Column, quiet: str) -> Column:
    return last_notified.isNull() | (last_notified + F.expr(f"INTERVAL {quiet}") <= now)


def memberships(people: DataFrame, book: str, person: str, role: str) -> DataFrame:
    """(book, person, keeps, acts): each person of a book once, whether custodian, whether assignee; those who are neither get nothing."""
    per = people.groupBy(book, person).agg(F.max(F.coalesce(F.col(role) == "custodian", F.lit(False))).alias("keeps"), F.max(F.coalesce(F.col(role) == "assignee", F.lit(False))).alias("acts"))
    return per.where("keeps OR acts")


def audiences(people: DataFrame, book: str, person: str, role: str) -> DataFrame:
    """(book, _loud, person): who gets the notes of a book, the loud ones and the others: custodians every note, assignees all but information."""
    who = memberships(people, book, person, role)
    return who.select(book, person, F.explode(F.when(F.col("keeps"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("_loud"))


def notes_once(notes: DataFrame, note: str, book: str, author: str, severity: str) -> tuple[DataFrame, DataFrame]:
    """(note, book, author, _loud) of the notes that are there once, and the distinct rows of the others, whose pairs may repeat."""
    loud = F.coalesce(F.col(severity) != "info", F.lit(False))
    own = notes.select(note, book, author, loud.alias("_loud")).where(F.col(book).isNotNull())
    per_note = own.groupBy(note).agg(F.count(F.lit(1)).alias("_n"), F.first(book).alias(book), F.first(author).alias(author), F.first("_loud").alias("_loud"))
    repeated = per_note.where("_n > 1").select(F.col(note).alias("_note"))
    return per_note.where("_n = 1").drop("_n"), own.join(repeated, F.col(note).eqNullSafe(F.col("_note")), "left_semi").distinct()


def told(notes: DataFrame, who: DataFrame, by: list[str], note: str, author: str, person: str) -> DataFrame:
    """Notes with those who get them, in blocks: every person of the audience that the columns ``by`` name, but the author."""
    return all_pairs(notes, who, by, note, person).where(~F.col(person).eqNullSafe(F.col(author)))


def fan_out(notes: DataFrame, people: DataFrame, note: str, book: str, author: str, person: str, role: str, severity: str) -> DataFrame:
    """Custodians get every note, assignees all but information, the author none; each person once.

    People are made unique per book and notes are counted before they meet. A note that is there once makes each of its pairs once, so only
    the pairs of notes that are there more than once are shuffled to drop the repeated ones. Notes and people meet in blocks.
    """
    once, again = (df.withColumn("_again", F.lit(i)) for i, df in enumerate(notes_once(notes, note, book, author, severity)))
    met = told(once.unionByName(again), audiences(people, book, person, role), [book, "_loud"], note, author, person)
    return met.where("_again = 0").select(note, person).unionByName(met.where("_again = 1").select(note, person).distinct())


def interrupts(severity: Column) -> Column:
    return severity != "info"


def digests(rows: DataFrame, person: str, book: str, rank: str) -> DataFrame:
    """Per person: notes, books, and the loudest severity. Nobody's notes are gathered into one row; ``digest_order`` has them."""
    per_book = rows.groupBy(person, book).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("worst"))
    return per_book.groupBy(person).agg(F.sum("n").alias("n_notes"), F.count(F.lit(1)).alias("n_books"), F.min("worst").alias("worst"))


def digest_order(rows: DataFrame, person: str, book: str, rank: str, at: str, note: str) -> DataFrame:
    """Notes with their book's place in the person's digest (the loudest first) and their own in the book (loudest, then oldest)."""
    books = rows.groupBy(person, book).agg(F.min(rank).alias("worst"))
    books = books.withColumn("book_place", F.row_number().over(Window.partitionBy(person).orderBy("worst", book)))
    place = F.row_number().over(Window.partitionBy(person, book).orderBy(rank, at, note))
    return rows.join(books, [person, book]).withColumn("place", place)


def digest_due(notes: DataFrame, ledger: DataFrame, people: DataFrame, now: Column, min_age_minutes: int) -> DataFrame:
    """(person, note): unread notes old enough that no digest had, of active people; ``ledger`` is what was sent."""
    old = notes.where(F.col("read_at").isNull() & (F.col("created_at") < now - F.expr(f"INTERVAL {min_age_minutes} MINUTES")))
    return old.join(ledger.select("person", "note"), ["person", "note"], "left_anti").join(people.where("is_active").select("person"), "person", "left_semi")


def badges(notes: DataFrame, person: str, unread: Column, rank: str) -> DataFrame:
    return notes.groupBy(person).agg(F.count_if(unread).alias("badge"), F.min(F.when(unread, F.col(rank))).alias("loudest"))
