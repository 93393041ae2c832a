"""Document evidence as Spark relations: segmentation, retrieval, grounded answers, terms, reports, task history."""
