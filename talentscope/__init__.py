"""talentscope: Spark jobs for document search and search analytics."""
