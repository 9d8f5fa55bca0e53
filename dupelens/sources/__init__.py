"""Where inventories come from: tables, trees, binary files, small stores."""
