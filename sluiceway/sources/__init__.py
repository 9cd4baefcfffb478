"""Sources and sinks: manifests, files under capabilities, the block catalog and bundles."""
