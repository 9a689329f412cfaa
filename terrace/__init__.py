"""terrace: document retrieval and corpus analytics expressed as Spark DataFrame jobs."""
