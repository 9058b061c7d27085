"""A small bundled library to try the engine on: eight papers, nine citations, five topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, year, venue, title, authors, topics.
PAPERS = (
    ("demo:alexnet", 2012, "NeurIPS", "ImageNet Classification with Deep Convolutional Neural Networks", ("Alex Krizhevsky", "Ilya Sutskever", "Geoffrey E. Hinton"), ("topic:computer-vision", "topic:deep-architectures")),
    ("demo:seq2seq", 2014, "NeurIPS", "Sequence to Sequence Learning with Neural Networks", ("Ilya Sutskever", "Oriol Vinyals", "Quoc V. Le"), ("topic:sequence-modeling", "topic:deep-architectures")),
    ("demo:resnet", 2015, "CVPR", "Deep Residual Learning for Image Recognition", ("Kaiming He", "Xiangyu Zhang", "Shaoqing Ren", "Jian Sun"), ("topic:computer-vision", "topic:deep-architectures")),
    ("demo:transformer", 2017, "NeurIPS", "Attention Is All You Need", ("Ashish Vaswani", "Noam Shazeer", "Niki Parmar", "Jakob Uszkoreit", "Llion Jones", "Aidan N. Gomez", "Łukasz Kaiser", "Illia Polosukhin"), ("topic:attention", "topic:sequence-modeling", "topic:deep-architectures")),
    ("demo:bert", 2018, "NAACL", "BERT: Pre-training of Deep Bidirectional Transformers for Language Understanding", ("Jacob Devlin", "Ming-Wei Chang", "Kenton Lee", "Kristina Toutanova"), ("topic:language-modeling", "topic:attention")),
    ("demo:gpt2", 2019, "OpenAI technical report", "Language Models are Unsupervised Multitask Learners", ("Alec Radford", "Jeffrey Wu", "Rewon Child", "David Luan", "Dario Amodei", "Ilya Sutskever"), ("topic:language-modeling", "topic:attention")),
    ("demo:gpt3", 2020, "NeurIPS", "Language Models are Few-Shot Learners", ("Tom B. Brown", "Benjamin Mann", "Nick Ryder", "Melanie Subbiah", "Jared Kaplan", "Prafulla Dhariwal", "Arvind Neelakantan", "Pranav Shyam", "Girish Sastry", "Amanda Askell"), ("topic:language-modeling", "topic:attention")),
    ("demo:vit", 2020, "ICLR", "An Image is Worth 16x16 Words: Transformers for Image Recognition at Scale", ("Alexey Dosovitskiy", "Lucas Beyer", "Alexander Kolesnikov", "Dirk Weissenborn", "Xiaohua Zhai", "Thomas Unterthiner", "Mostafa Dehghani"), ("topic:computer-vision", "topic:attention")),
)
#: Who cites whom.
EDGES = (
    ("demo:seq2seq", "demo:alexnet"), ("demo:resnet", "demo:alexnet"), ("demo:transformer", "demo:seq2seq"), ("demo:bert", "demo:transformer"), ("demo:gpt2", "demo:transformer"),
    ("demo:gpt3", "demo:transformer"), ("demo:gpt3", "demo:gpt2"), ("demo:vit", "demo:transformer"), ("demo:vit", "demo:resnet"),
)
#: Topics and their names.
TOPICS = {"topic:sequence-modeling": "Sequence modeling", "topic:attention": "Attention", "topic:language-modeling": "Language models", "topic:computer-vision": "Computer vision", "topic:deep-architectures": "Deep architectures"}


def library(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, edges and topics in the columns that views, graphs and layouts read."""
    none = F.array().cast("array<string>")
    papers = spark.createDataFrame([(*p[:4], list(p[4]), list(p[5])) for p in PAPERS], "id string, year int, venue string, title string, authors array<string>, topics array<string>")
    papers = papers.withColumns({"type": F.lit("Conference"), "tags": F.array(F.lit("demo")), "keywords": none, "abstract": F.lit(""), "starred": ~F.col("id").isin("demo:resnet", "demo:bert", "demo:gpt2", "demo:vit"), "citationCount": F.lit(None).cast("bigint"), "source": F.lit("demo"), "status": F.lit("read")})
    edges = spark.createDataFrame([(f"{a}->{b}", a, b) for a, b in EDGES], "id string, source string, target string").withColumns({"kind": F.lit("citation"), "relation": F.lit(None).cast("string"), "provenance": F.lit("demo")})
    topics = spark.createDataFrame(list(TOPICS.items()), "id string, name string").withColumn("source", F.lit("demo"))
    return papers, edges, topics
