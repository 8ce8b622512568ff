"""Conversations: histories, sources, grounded prompts, citations, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a history, characters of an excerpt.
HISTORY, EXCERPT = 6, 500


def history(messages: DataFrame, conversation: str, order: list[Column], n: int = HISTORY) -> DataFrame:
    """The last n messages of each conversation; `order` has the latest first."""
    w = Window.partitionBy(conversation).orderBy(*order)
    return messages.withColumn("back", F.row_number().over(w).cast("long")).filter(F.col("back") <= n)


def label_sources(contexts: DataFrame, group: str, order: str) -> DataFrame:
    """source_label: S1, S2, ... in order."""
    return contexts.withColumn("source_label", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy(group).orderBy(order))))


def source_block(label: Column, title: Column, location: Column, content: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("["), label, F.lit("] "), title), F.when(location != "", location), content)


def grounded_prompt(sources: DataFrame, group: str, question: Column) -> DataFrame:
    """One prompt a group: its sources in the order of their labels, then the question."""
    ordered = F.array_sort(F.collect_list(F.struct(F.substring("source_label", 2, 10).cast("int").alias("n"), F.col("block"))))
    return sources.groupBy(group).agg(F.concat_ws("\n\n", F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n"), F.max(question)).alias("prompt"), F.count("*").alias("sources"))


def cited(answer: Column | str) -> Column:
    """The labels that an answer cites, told apart, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S\d+)\]"), F.lit(1)))


def citations(answers: DataFrame, sources: DataFrame, message: str, text: str) -> DataFrame:
    """The sources that each answer cites, in the sources' order, with citation_index and an excerpt."""
    labels = answers.select(message, F.explode(cited(text)).alias("source_label"))
    hit = labels.join(sources, [message, "source_label"])
    w = Window.partitionBy(message).orderBy(F.substring("source_label", 2, 10).cast("int"))
    return hit.withColumn("citation_index", F.row_number().over(w).cast("long")).withColumn("excerpt", F.left("content", F.lit(EXCERPT)))


def refusal(question: Column | str) -> Column:
    """What is said where no source was found, in the question's script."""
    return F.when(F.regexp_count(question, F.lit(r"[\x{3400}-\x{9fff}]")) > 0, "未找到足够的依据，无法回答。").otherwise("No sufficient evidence was found to answer this question.")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """By prices a million tokens. Null where neither is priced."""
    total = (F.coalesce(tokens_in, F.lit(0)) * F.coalesce(price_in, F.lit(0.0)) + F.coalesce(tokens_out, F.lit(0)) * F.coalesce(price_out, F.lit(0.0))) / 1e6
    return F.when(price_in.isNull() & price_out.isNull(), None).otherwise(total)


def location_text(locators: Column | str) -> Column:
    """Where a source stands: pages, slides and sheets, each once."""
    parts = F.transform(locators, lambda x: F.concat_ws(" ", F.when(x["page_number"].isNotNull(), F.concat(F.lit("page "), x["page_number"])), F.when(x["slide_number"].isNotNull(), F.concat(F.lit("slide "), x["slide_number"])), F.when(x["sheet_name"].isNotNull(), F.concat(F.lit("sheet "), x["sheet_name"]))))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "; ")


def route(tool_calls: Column, has_documents: Column) -> Column:
    """One call of a tool goes to it; otherwise documents where there are some, or a direct answer."""
    return F.when(F.size(tool_calls) == 1, F.try_element_at(tool_calls, F.lit(1))).when(has_documents, "documents").otherwise("direct")
