"""Topic analytics over a lake of short posts, written as Spark jobs."""
