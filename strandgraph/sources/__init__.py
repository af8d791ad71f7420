"""Sources: files of a project, their syntax as rows of nodes, single-file components, JSON in and out."""
