"""Document intelligence on Spark: chunking, retrieval, knowledge graph, answers, chats, evals."""

__version__ = "0.1.0"
