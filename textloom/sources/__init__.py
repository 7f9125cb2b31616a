"""Page sources: tables, HTML, link crawl."""
